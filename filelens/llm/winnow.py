"""Line dedup by winnowing over line hashes, in DataFrame operations only.

A repeated run is a stretch of consecutive lines (blank ones aside) of at
least ``min_words`` words that equals a stretch earlier in the corpus, where
documents are ordered by id. Its lines are deleted.

1. Fingerprints. From every line on, the window is the shortest stretch that
   reaches ``min_words``; the least line hash in it (the first, if several are
   alike) is selected. A window's content decides which line that is, and a
   repeated run holds the window of its first line, so every repeated run has
   a fingerprint in common with what it repeats. Neighbouring windows mostly
   select the same line: only these minima are dealt by their hash.
2. Positions. Fingerprints that occur at more than one position are joined
   back to their positions; text without any is done with.
3. Extension. Around each such position the match is extended both ways: the
   forward windows (from each line on) and the backward windows (back from
   each line) that hold it are compared as wholes, by 128 bits of all their
   lines, with the first occurrence of the same content. Equal windows overlap
   into the whole run: the forward windows cover a run up to its last
   ``min_words`` words, the backward window of its last line covers these.

Positions meet at a window's first occurrence, never in pairs. A deleted line
always has an equal line earlier, so every line's first occurrence stays.

Defined cases: a null text stays null and has no lines; an empty or blank text
stays; a blank line goes only with a document that has no words left; rows
that repeat an id are ordered by the table's order; other columns are kept
(one named ``n_deleted_lines`` gives way to the operator's own in
:func:`dedup`, and stays in :func:`drop_repeats`); an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filelens.operators.common import materialized

from .common import WORD, col, fresh

MIN_WORDS = 50


def lines_of(texts: DataFrame) -> DataFrame:
    """(k, doc_id, pos, words, h) of every line of (k, doc_id, text); ``h`` is
    128 bits of the line."""
    split = texts.select("k", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return split.select("k", "doc_id", "pos", F.regexp_count("line", F.lit(WORD)).cast("long").alias("words"),
                        F.struct(F.xxhash64("line").alias("a"), F.xxhash64("line", F.lit(1)).alias("b")).alias("h"))


def _placed(lines: DataFrame) -> DataFrame:
    """Lines with words, with their number ``n`` in the document and the words
    before (``start``) and up to them (``end``)."""
    in_order = Window.partitionBy("k").orderBy("pos")
    return lines.where("words > 0").withColumns({
        "n": F.row_number().over(in_order),
        "end": F.sum("words").over(in_order.rowsBetween(Window.unboundedPreceding, 0))}) \
        .withColumn("start", F.col("end") - F.col("words"))


def _frames(min_words: int):
    """A line belongs to the window from line i on if it starts within
    ``min_words`` words of i's start; backwards the same with the ends."""
    in_doc = Window.partitionBy("k")
    return (in_doc.orderBy("start").rangeBetween(0, min_words - 1),
            in_doc.orderBy(F.desc("end")).rangeBetween(0, min_words - 1))


def fingerprints(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(k, pos, fingerprint): the lines selected by some full window, once each."""
    ahead, _ = _frames(min_words)
    least = _placed(lines).select("k", "n", F.sum("words").over(ahead).alias("total"),
                                  F.min(F.struct(F.col("h.a").alias("fingerprint"), "pos")).over(ahead).alias("least"))
    # windows move on, and so do their minima: a line is new where the choice changes
    before = F.lag("least.pos").over(Window.partitionBy("k").orderBy("n"))
    return least.where(F.col("total") >= min_words).withColumn("before", before) \
        .where(~F.col("before").eqNullSafe(F.col("least.pos"))).select("k", "least.pos", "least.fingerprint")


def repeated_positions(seeds: DataFrame) -> DataFrame:
    """(k, pos) of the fingerprints that occur at more than one position."""
    often = seeds.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    return seeds.join(often, "fingerprint").select("k", "pos")


def extensions(lines: DataFrame, positions: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(k, doc_id, first, last, content): the forward and backward windows that
    hold one of ``positions``, by numbers of the lines with words."""
    # the positions go along as rows of their documents: one exchange for all
    marks = positions.select("k", F.lit(None).cast("long").alias("doc_id"), "pos", F.lit(None).cast("long").alias("words"),
                             F.lit(None).cast(lines.schema["h"].dataType).alias("h"), F.lit(True).alias("held"))
    rows = lines.where("words > 0").withColumn("held", F.lit(False)).unionByName(marks).repartition("k")
    marked = rows.withColumn("held", F.max("held").over(Window.partitionBy("k", "pos"))) \
        .withColumn("any", F.max("held").over(Window.partitionBy("k"))).where(F.col("any") & F.col("words").isNotNull())
    ahead, back = _frames(min_words)

    def window(over, other_way: bool):
        hashes = F.collect_list("h").over(over)
        return F.struct(F.min("n").over(over).alias("first"), F.max("n").over(over).alias("last"),
                        F.sum("words").over(over).alias("words"), F.max("held").over(over).alias("held"),
                        (F.reverse(hashes) if other_way else hashes).alias("hashes"))

    both = _placed(marked).select("k", "doc_id", window(ahead, False).alias("f"), window(back, True).alias("b"))
    each = both.select("k", "doc_id", F.explode(F.array("f", "b")).alias("w")) \
        .where((F.col("w.words") >= min_words) & F.col("w.held"))
    content = F.struct(F.xxhash64("w.hashes").alias("a"), F.xxhash64("w.hashes", F.lit(1)).alias("b"))
    return each.select("k", "doc_id", "w.first", "w.last", content.alias("content")).distinct()


def repeated_lines(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(k, n): the lines (numbers of lines with words) of later repeated runs."""
    seeds = materialized(fingerprints(lines, min_words), "winnow-fingerprints")
    windows = materialized(extensions(lines, repeated_positions(seeds), min_words), "winnow-windows")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k", "first")
    seen = materialized(
        windows.groupBy("content").agg(F.min(place).alias("source"), F.count(F.lit(1)).alias("times"))
        .where("times > 1").select("content", "source"), "winnow-sources")
    later = windows.join(seen, "content").where(
        (F.col("k") != F.col("source.k")) | (F.col("first") != F.col("source.first")))
    return later.select("k", F.explode(F.sequence("first", "last")).alias("n")).distinct()


def _cleaned(texts: DataFrame, min_words: int) -> DataFrame:
    """(k, deleted, gone): per changed document a flag per line and the
    number of deleted lines."""
    lines = materialized(lines_of(texts), "winnow-lines")
    gone = materialized(repeated_lines(lines, min_words), "winnow-repeated")
    numbered = lines.join(gone.select("k").distinct(), "k", "left_semi").select(
        "k", "pos", "words", F.sum((F.col("words") > 0).cast("int")).over(
            Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).alias("n"))
    flags = numbered.join(gone.withColumn("hit", F.lit(True)), ["k", "n"], "left") \
        .select("k", "pos", (F.coalesce("hit", F.lit(False)) & (F.col("words") > 0)).alias("del"))
    return flags.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("pos", "del"))).alias("f"),
                                  F.sum(F.col("del").cast("long")).alias("gone")) \
        .select("k", F.transform("f", lambda x: x["del"]).alias("deleted"), "gone")


def _deduped(docs: DataFrame, count: str, min_words: int) -> DataFrame:
    """All columns of ``docs``, with the text without its repeated runs, and
    the number of deleted lines in the new column ``count``."""
    k, deleted, gone = (fresh(n, docs) for n in ("winnow_row", "winnow_deleted", "winnow_gone"))
    texts = materialized(docs.withColumn(k, F.monotonically_increasing_id()), "winnow-texts")
    changed = _cleaned(texts.select(col(k).alias("k"), col("doc_id"), col("text")), min_words)
    out = texts.join(changed.select(F.col("k").alias(k), F.col("deleted").alias(deleted), F.col("gone").alias(gone)),
                     k, "left")
    kept = F.filter(F.arrays_zip(F.split(col("text"), "\n", -1).alias("line"), col(deleted).alias("d")), lambda x: ~x["d"])
    text = F.when(col(deleted).isNull(), col("text")).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    cols = [text.alias("text") if c == "text" else col(c) for c in docs.columns]
    return out.select(*cols, F.coalesce(col(gone), F.lit(0)).alias(count))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` (doc_id, text) with the text without its
    repeated runs, and ``n_deleted_lines``."""
    others = docs.select(*[col(c) for c in docs.columns if c.lower() != "n_deleted_lines"])
    return _deduped(others, "n_deleted_lines", min_words)


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without repeated runs, with its columns; a document that had
    words and has none left is dropped, and ``n_chars`` (if there) follows the
    text."""
    count = fresh("winnow_count", docs)
    out = _deduped(docs, count, min_words)
    left = out.where((col(count) == 0) | F.coalesce(col("text").rlike(WORD), F.lit(False)))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(col(count) == 0, col("n_chars"))
                               .otherwise(F.length(col("text")).cast(docs.schema["n_chars"].dataType)))
    return left.select(*[col(c) for c in docs.columns])


# The same by text instead of hashes
ORACLE = r"""
WITH split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                      generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
lines AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM split),
numbered AS (SELECT doc_id, pos, line, words, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n,
                    sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS stop FROM lines WHERE words > 0),
placed AS (SELECT *, stop - words AS start FROM numbered),
windows AS (
  SELECT DISTINCT doc_id, first, last, content FROM (
    SELECT doc_id, min(n) OVER w AS first, max(n) OVER w AS last, sum(words) OVER w AS total,
           list(line) OVER w AS content
    FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
    UNION ALL
    SELECT doc_id, min(n) OVER w, max(n) OVER w, sum(words) OVER w, list(line) OVER w
    FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY stop RANGE BETWEEN 49 PRECEDING AND CURRENT ROW))
  WHERE total >= 50),
ranked AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, first) AS nth FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(first, last)) AS n FROM ranked WHERE nth > 1),
flagged AS (SELECT l.doc_id, l.pos, l.line, g.n IS NOT NULL AS hit
            FROM lines l LEFT JOIN placed p ON p.doc_id = l.doc_id AND p.pos = l.pos
            LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.n = p.n),
rebuilt AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT hit), '') AS text,
                   count(*) FILTER (hit) AS n_deleted_lines FROM flagged GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN coalesce(r.n_deleted_lines, 0) = 0 THEN d.text ELSE r.text END AS text,
       coalesce(r.n_deleted_lines, 0) AS n_deleted_lines
FROM documents d LEFT JOIN rebuilt r USING (doc_id)
"""
