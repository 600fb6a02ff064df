"""Source divergence audit: how far the words of each source are from those of
the other sources, and of all, of its language.

Partial counts come from Arrow's compute functions inside the scanning tasks:
``ascii_lower``, ``split_pattern_regex``, ``dictionary_encode`` and hash
``group_by`` turn slices of texts into occurrences and documents per
(language, source, term). A task merges its slices until their table reaches
``PARTIAL_ROWS``. Spark adds the partial counts, so that a frequent term costs
a row per task; one row per kept term has its counts by source. These rows go
to shards of a language's terms (a hot language has many), each beside the
sizes of the language's groups, and a shard is one integer matrix of sources by
terms from which the divergences follow. Shards emit one sum per pair of
sources and their highest terms, never terms by pairs.

All arithmetic is exact: proportions come digit by digit from 64-bit
remainders (counts up to 9e15), sums of divergences stay below 2**63.

Defined cases: a null text, language or source is ''; repeated rows are
documents of their own; a group without terms takes part with count 0, and
with no kept terms its values are 0; a language with one source has no pairs;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filelens.operators.common import materialized

from .common import col

MIN_DOCS = 3              # documents of the language that hold a kept term
SCALE_DIGITS = 9          # proportions are in units of 10**-9
TOP_TERMS = 200
PARTIAL_ROWS = 1 << 20    # rows of a task's table of partial counts
SLICE_BYTES = 1 << 22     # of text counted at a time
SHARD_CELLS = 1 << 20     # sources by terms of a shard, about
# Bytes between terms: everything below U+0080 that is no letter
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"

_PARTIAL = "lang string, source string, term string, n bigint, docs bigint"


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about ``SLICE_BYTES`` of text; a longer text alone."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(False).astype(np.int64))
    at = 0
    while at < len(batch):
        base = size[at - 1] if at else 0
        end = max(int(np.searchsorted(size, base + SLICE_BYTES, "right")), at + 1)
        # copied, since ascii_lower misreads the offsets of a slice
        yield batch.take(pa.array(np.arange(at, end)))
        at = end


def count_terms(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of one slice; a group is there with a
    null term, too."""
    text, lang, source = (pc.fill_null(batch.column(c), "").cast(pa.large_string()) for c in ("text", "lang", "source"))
    parts = pc.split_pattern_regex(pc.ascii_lower(text), pattern=BETWEEN)
    doc, flat = pc.list_parent_indices(parts), pc.list_flatten(parts)
    some = pc.greater(pc.binary_length(flat), 0)
    words = flat.filter(some).dictionary_encode()
    per_doc = pa.table({"doc": doc.filter(some), "word": words.indices}) \
        .group_by(["doc", "word"], use_threads=False).aggregate([([], "count_all")])
    at = per_doc["doc"]
    rows = pa.table({"lang": lang.take(at), "source": source.take(at),
                     "term": words.dictionary.take(per_doc["word"]).cast(pa.large_string()),
                     "n": per_doc["count_all"], "docs": pa.array(np.ones(len(per_doc), np.int64))})
    here = pa.table({"lang": lang, "source": source, "term": pa.nulls(len(batch), pa.large_string()),
                     "n": pa.array(np.zeros(len(batch), np.int64)), "docs": pa.array(np.zeros(len(batch), np.int64))})
    return merged([rows, here])


def merged(tables: list[pa.Table]) -> pa.Table:
    keys = ["lang", "source", "term"]
    out = pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return out.select([*keys, "n_sum", "docs_sum"]).rename_columns([*keys, "n", "docs"])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()),
                        ("n", pa.int64()), ("docs", pa.int64())])
    waiting, rows = [], 0
    for b in batches:
        for s in _slices(b):
            waiting.append(count_terms(s))
            rows += len(waiting[-1])
            if rows > PARTIAL_ROWS:
                waiting = [merged(waiting)]
                rows = len(waiting[0])
                if rows > PARTIAL_ROWS // 2:  # mostly new terms: emit and start afresh
                    yield from waiting[0].cast(schema).to_batches(max_chunksize=1 << 16)
                    waiting, rows = [], 0
    if waiting:
        yield from merged(waiting).cast(schema).to_batches(max_chunksize=1 << 16)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with one, of
    every term in every group; with a null term once per group. Written."""
    rows = docs.select(*[col(c).cast("string").alias(c) for c in ("text", "lang", "source")])
    return materialized(rows.mapInArrow(_partial, _PARTIAL).groupBy("lang", "source", "term")
                        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")


def proportion(count: np.ndarray, size, kept: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 1) / (size + kept)), exactly."""
    whole = np.asarray(size, np.int64) + np.int64(kept)
    rest = np.asarray(count, np.int64) + 1
    out = rest // whole
    rest = rest % whole
    for _ in range(SCALE_DIGITS // 3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


_SHARD = "lang string, source string, part string, item string, value bigint"


def _shard(top: int):
    """One shard of a language's terms, beside the sizes of all its groups:
    the shard's part of each pair's sum, and each group's highest terms."""
    schema = pa.schema([(c, pa.string()) for c in ("lang", "source", "part", "item")] + [("value", pa.int64())])

    def run(terms: pa.Table, sizes: pa.Table) -> pa.Table:
        if not len(sizes):
            return schema.empty_table()
        sizes = sizes.sort_by("source")
        lang, kept = sizes["lang"][0].as_py(), sizes["kept"][0].as_py()
        source = sizes["source"].combine_chunks()
        n, s = sizes["size"].to_numpy(), len(source)
        sums, out = np.zeros((s, s), np.int64), []
        terms = terms.sort_by("term")
        step = max(1, SHARD_CELLS // s)
        for at in range(0, len(terms), step):
            some = terms.slice(at, step)
            counts = some["counts"].combine_chunks()
            row = pc.list_parent_indices(counts).to_numpy(False)
            cells = pc.list_flatten(counts)
            mine = pc.index_in(cells.field("source"), value_set=source).to_numpy(False)
            c = np.zeros((s, len(some)), np.int64)
            c[mine, row] = cells.field("n").to_numpy(False)
            p = proportion(c, n[:, None], kept)
            for i in range(s):
                sums[i] += _divergence(p[i], p).sum(axis=1)
            q = proportion(c.sum(axis=0), n.sum(), kept)
            f = np.where((c > 0) & (p > q), _divergence(p, q), -1)
            items = some["term"].combine_chunks()
            for i in range(s):
                hit = np.flatnonzero(f[i] >= 0)
                # terms are in order, so a stable sort breaks ties by term
                hit = hit[np.argsort(-f[i][hit], kind="stable")][:top]
                if len(hit):
                    out.append(pa.table([pa.array([lang] * len(hit)), pa.array([source[i].as_py()] * len(hit)),
                                         pa.array(["term"] * len(hit)), items.take(pa.array(hit)).cast(pa.string()),
                                         pa.array(f[i][hit])], schema=schema))
        a, b = np.nonzero(~np.eye(s, dtype=bool))
        if len(a):
            out.append(pa.table([pa.array([lang] * len(a)), source.take(pa.array(a)).cast(pa.string()),
                                 pa.array(["pair"] * len(a)), source.take(pa.array(b)).cast(pa.string()),
                                 pa.array(sums[a, b])], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()
    return run


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): per group the divergence from
    each other source of its language (``pair``) and the terms that it has
    most above its language (``term``, ``top`` of them)."""
    counts = term_counts(docs)
    kept = materialized(
        counts.where("term is not null").groupBy("lang", "term")
        .agg(F.collect_list(F.struct("source", "n")).alias("counts"), F.sum("docs").alias("docs"))
        .where(F.col("docs") >= min_docs).select("lang", "term", "counts"), "kept-terms")
    size = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")) \
        .agg(F.sum("c.n").alias("size"))
    words = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    groups = counts.where("term is null").select("lang", "source").join(size, ["lang", "source"], "left") \
        .join(words, "lang", "left").select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "kept")])
    per_lang = groups.groupBy("lang").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("sources"))
    shards = materialized(per_lang.select("lang", F.ceil(
        F.greatest(F.col("kept") * F.col("sources") / SHARD_CELLS, F.lit(1))).cast("int").alias("shards")), "shards")
    dealt = kept.join(shards, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int"))
    told = groups.join(shards, "lang").withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    found = dealt.select("lang", "shard", "term", "counts").groupBy("lang", "shard").cogroup(
        told.select("lang", "shard", "source", "size", "kept").groupBy("lang", "shard")).applyInArrow(_shard(top), _SHARD)
    sums = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return sums.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY ALL),
sizes AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS size FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
cells AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
                 CAST(1 + (1000000000 * (coalesce(c.n, 0)::HUGEINT + 1)) // (s.size + v.v) AS HUGEINT) AS p
          FROM sizes s JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
whole AS (SELECT k.lang, k.term, CAST(1 + (1000000000 * (sum(n)::HUGEINT + 1)) // (any_value(t.size) + any_value(v.v)) AS HUGEINT) AS q
          FROM k JOIN c USING (lang, term) JOIN (SELECT lang, sum(size) AS size FROM sizes GROUP BY ALL) t USING (lang)
          JOIN v USING (lang) GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
          FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
          UNION ALL
          SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM cells JOIN whole USING (lang, term)
          WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
                  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
           FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
