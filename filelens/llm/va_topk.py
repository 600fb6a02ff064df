"""Exact top-k search by vector-approximation files.

Each vector (whole numbers, floor(64 x)) has an approximation: per component
the number of a cell of at most ``2**BITS`` quantile cells. The scan reads
approximations only; a cell's ends bound the inner product from both sides. A
candidate whose upper bound is below a query's k-th lower bound is out. The
exact vectors are then read in the order of the upper bounds, in two steps:
the first k of each query fix a score that k candidates surely reach, and
only those whose bound is not below it follow.

Blocks of queries meet blocks of approximations; a candidate block goes to
every query block, as the stated query set runs against all rows. Rows of the
same vector are one candidate (with the k + 1 least ids, which are the only
ones that a result can hold), so ties between copies cost nothing.

Pairs with a vector that has a whole number of 2**20 or more have a path of
their own: bounds are inner products in doubles with their rounding error
added outward, and what they leave is scored with Python's integers.

Defined cases: vectors that are null, or hold a null or a non-finite
component (or a double that is not finite times 64), take no part; neither do rows without an id; every row is a
candidate, also one that repeats id and vector, and further vectors of an id
are rows of their own (a query's rows share one ranking, in which a candidate
stands once for each of them, and no row of its id is in it); vectors of
different length do not score with one another; an empty vector scores 0 with
the others; a score beyond 64 bits is ranked by its exact value and shown as
the nearest 64-bit number; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filelens.operators.common import materialized

from .common import col

SCALE = 64
LARGEST = 1 << 20     # below, products of up to 8,192 components stay whole in doubles
K = 20
BITS = 6
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
TILE = 2048          # candidates scored at once: 1024 x 2048 doubles are 16 MB


def whole_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, v, times, large): the rows with a usable vector, as whole
    numbers in doubles (from 2**53 on every double is one), and how many there
    are of each."""
    scaled = F.transform(col("embedding"), lambda e: e.cast("double") * SCALE)
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0 ** 53, F.floor(x).cast("double")).otherwise(x))
    # finite, and finite when scaled
    fine = F.forall(scaled, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(col("vec_id").isNotNull() & col("embedding").isNotNull() & fine) \
        .groupBy(col("vec_id").alias("vec_id"), whole.alias("v")).agg(F.count(F.lit(1)).alias("times")) \
        .withColumn("large", F.exists("v", lambda x: F.abs(x) >= LARGEST))


def _least_ids(keep: int):
    """Map-side: each distinct vector of a batch with its least ids."""
    def run(batches):
        for b in batches:
            ids = b.column("vec_id").to_numpy(False)
            group = b.column("g").to_numpy(False)
            order = np.lexsort((ids, group))
            new = np.ones(len(order), bool)
            new[1:] = group[order][1:] != group[order][:-1]
            nth = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            yield b.take(pa.array(order[nth < keep]))
    return run


def candidates(vectors: DataFrame, keep: int) -> DataFrame:
    """(v, ids): distinct vectors with their ``keep`` least ids (vec_id, times),
    ascending. Copies are thinned where they are read, before the shuffle."""
    keyed = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.xxhash64("v").alias("g"), "v", "times")
    thin = keyed.mapInArrow(_least_ids(keep), "vec_id bigint, g bigint, v array<double>, times bigint")
    w = Window.partitionBy("v").orderBy("vec_id")
    return thin.withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep) \
        .groupBy("v").agg(F.sort_array(F.collect_list(F.struct("vec_id", "times"))).alias("ids"))


def cells(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """(dim, i, ends): ascending upper ends of the cells of component ``i`` of
    the vectors of ``dim`` components, at quantiles of all vectors."""
    n = 1 << bits
    parts = distinct.select(F.size("v").alias("dim"), F.posexplode("v").alias("i", "x"))
    per = parts.groupBy("dim", "i").agg(
        F.percentile_approx("x", [k / n for k in range(1, n + 1)], 4 * n).alias("ends"),
        F.min("x").alias("low"), F.max("x").alias("high"))
    return per.select("dim", "i", "low", F.array_distinct(F.concat("ends", F.array("high"))).alias("ends"))


def _pack_blocks(schema: pa.Schema, size: int, kind=np.int64):
    """Rows (dim, id, id2, id3, v) -> blocks (dim, n, ids, ids2, ids3, body) of a task."""
    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            dims = b.column("dim").to_numpy(False)
            for d in np.unique(dims).tolist():
                at = pa.array(np.flatnonzero(dims == d))
                held.setdefault(d, []).append(b.take(at))
                if sum(x.num_rows for x in held[d]) >= size:
                    yield from _blocks(d, held.pop(d), schema, size, kind)
        for d in list(held):
            yield from _blocks(d, held.pop(d), schema, size, kind)
    return run


def _blocks(dim: int, parts: list, schema: pa.Schema, size: int, kind):
    rows = pa.Table.from_batches(parts).combine_chunks()
    for lo in range(0, rows.num_rows, size):
        part = rows.slice(lo, size)
        body = np.asarray(part.column("v").combine_chunks().flatten().to_numpy(False)).astype(kind)
        cols = [[dim], [part.num_rows]]
        cols += [[part.column(c).to_numpy().astype(np.int64).tobytes()] for c in ("id", "id2", "id3")] + [[body.tobytes()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema)], schema=schema)


_BLOCK = "dim int, n bigint, ids binary, ids2 binary, ids3 binary, body binary"
_BLOCK_ARROW = pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("ids", pa.binary()), ("ids2", pa.binary()),
                          ("ids3", pa.binary()), ("body", pa.binary())])


def _approximate(batches):
    """Blocks with their dimension's cells -> one byte per component, and per
    component the cells' lowest and highest values."""
    for b in batches:
        codes, lows, highs = [], [], []
        for r in range(b.num_rows):
            dim, n = b.column("dim")[r].as_py(), b.column("n")[r].as_py()
            v = np.frombuffer(b.column("body")[r].as_buffer(), np.int64).reshape(n, dim)
            table = {c["i"]: c for c in b.column("cells")[r].as_py() or []}
            most = max((len(c["ends"]) for c in table.values()), default=1)
            code = np.zeros((dim, n), np.uint8)
            low, high = np.zeros((dim, most), np.int64), np.zeros((dim, most), np.int64)
            for i in range(dim):
                ends = np.array(table[i]["ends"], np.int64)
                code[i] = np.searchsorted(ends, v[:, i])
                high[i, :len(ends)] = ends
                low[i, :len(ends)] = np.concatenate([[table[i]["low"]], ends[:-1] + 1])
            codes.append(code.tobytes())
            lows.append(low.tobytes())
            highs.append(high.tobytes())
        yield pa.RecordBatch.from_arrays(
            [b.column("dim"), b.column("n"), b.column("ids"), b.column("ids2"), b.column("ids3"),
             *(pa.array(x, pa.binary()) for x in (codes, lows, highs))],
            ["dim", "n", "ids", "ids2", "ids3", "codes", "lows", "highs"])


_CODED = "dim int, n bigint, ids binary, ids2 binary, ids3 binary, codes binary, lows binary, highs binary"


def _ints(b, name, r):
    return np.frombuffer(b.column(name)[r].as_buffer(), np.int64)


def _scan(k: int, bounds, number):
    """A query block and a candidate block -> per query the candidates that
    the block's own bounds cannot rule out: (query_id, qrow, cand, least, low,
    high). ``bounds`` gives both bounds of a tile of candidates."""
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                yield from _scan_block(b, r, k, bounds(b, r), number)
    return run


def _coded_bounds(b, r: int):
    """Bounds by the cells of the approximations."""
    dim, nq, n = b.column("dim")[r].as_py(), b.column("qn")[r].as_py(), b.column("n")[r].as_py()
    q = _ints(b, "qbody", r).reshape(nq, dim).astype(np.float64)
    code = np.frombuffer(b.column("codes")[r].as_buffer(), np.uint8).reshape(dim, n)
    width = len(_ints(b, "lows", r)) // max(1, dim)
    low, high = (_ints(b, c, r).reshape(dim, width) for c in ("lows", "highs"))
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    comp = np.arange(dim)[:, None]

    def tile(lo: int):
        c = code[:, lo:lo + TILE]
        cl, ch = low[comp, c].astype(np.float64), high[comp, c].astype(np.float64)
        return plus @ cl + minus @ ch, plus @ ch + minus @ cl
    return tile


def _double_bounds(b, r: int):
    """Bounds by products in doubles, with more than their rounding error."""
    dim, nq, n = b.column("dim")[r].as_py(), b.column("qn")[r].as_py(), b.column("n")[r].as_py()
    q, v = (np.frombuffer(b.column(c)[r].as_buffer(), np.float64).reshape(m, dim) for c, m in (("qbody", nq), ("body", n)))
    share = 4 * (dim + 2) * np.finfo(np.float64).eps

    def tile(lo: int):
        c = v[lo:lo + TILE].T
        with np.errstate(over="ignore", invalid="ignore"):
            product, error = q @ c, (np.abs(q) @ np.abs(c)) * share
            known = np.isfinite(product) & np.isfinite(error)
            return np.where(known, product - error, -np.inf), np.where(known, product + error, np.inf)
    return tile


def _scan_block(b, r: int, k: int, bounds, number):
    nq, n = b.column("qn")[r].as_py(), b.column("n")[r].as_py()
    qid, qrow, cand, least, second = (_ints(b, c, r) for c in ("qids", "qrows", "ids", "ids2", "ids3"))
    found: list[tuple] = []
    bar = np.full(nq, -np.inf)       # a query's k-th lower bound so far
    bar_rows = np.full((nq, k), -np.inf)
    for lo in range(0, n, TILE):
        below, above = bounds(lo)
        # a vector of the query's own id alone (one id: no second) is none for it
        e = slice(lo, lo + TILE)
        other = (qid[:, None] != least[None, e]) | (least[e] != second[e])
        below = np.where(other, below, -np.inf)
        both = np.concatenate([bar_rows, below], axis=1)
        bar_rows = -np.partition(-both, k - 1, axis=1)[:, :k]
        bar = np.maximum(bar, bar_rows.min(axis=1))
        i, j = np.nonzero((above >= bar[:, None]) & other)
        found.append((i, lo + j, below[i, j], above[i, j]))
    i, j, below, above = (np.concatenate(x) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 4
    keep = above >= bar[i]
    i, j, below, above = i[keep], j[keep], below[keep], above[keep]
    least = np.where(least[j] == qid[i], second[j], least[j])
    for s in range(0, len(i), 1 << 18):
        e = slice(s, s + (1 << 18))
        yield pa.RecordBatch.from_arrays(
            [pa.array(qid[i[e]]), pa.array(qrow[i[e]]), pa.array(cand[j[e]]), pa.array(least[e]),
             pa.array(below[e].astype(number)), pa.array(above[e].astype(number))],
            ["query_id", "qrow", "cand", "least", "low", "high"])


def _per_query(rows: DataFrame, order, keep: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))) \
        .where(F.col("_n") <= keep).drop("_n")


def _candidate_blocks(distinct: DataFrame, kind=np.int64) -> DataFrame:
    ids = F.col("ids.vec_id")
    return distinct.select(F.size("v").alias("dim"), F.col("cand").alias("id"), ids[0].alias("id2"),
                           F.when(F.size("ids") > 1, F.get(ids, F.lit(1))).otherwise(ids[0]).alias("id3"), "v") \
        .mapInArrow(_pack_blocks(_BLOCK_ARROW, CANDIDATE_BLOCK, kind), _BLOCK)


def _query_blocks(vectors: DataFrame, kind=np.int64) -> DataFrame:
    blocks = vectors.select(F.size("v").alias("dim"), F.col("vec_id").alias("id"), F.col("qrow").alias("id2"),
                            F.col("qrow").alias("id3"), "v").mapInArrow(_pack_blocks(_BLOCK_ARROW, QUERY_BLOCK, kind), _BLOCK)
    return materialized(blocks.select("dim", F.col("n").alias("qn"), F.col("ids").alias("qids"),
                                      F.col("ids2").alias("qrows"), F.col("body").alias("qbody"))
                        .withColumn("qblock", F.monotonically_increasing_id()), "va-queries")


def _met(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """Every candidate block with every query block of its dimension."""
    known = queries.groupBy("dim").agg(F.collect_list("qblock").alias("to"))
    sent = blocks.join(known, "dim").withColumn("qblock", F.explode("to")).drop("to", "dim")
    return sent.join(queries, "qblock").repartition(F.col("qblock"), F.xxhash64("ids"))


_BOUNDS = "query_id bigint, qrow bigint, cand bigint, least bigint, low {0}, high {0}"


def search(rows: DataFrame, is_query, k: int = K, bits: int = BITS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows of every row
    for which ``is_query`` (a column on ``vec_id``) holds."""
    vectors = materialized(whole_vectors(rows).withColumn("qrow", F.monotonically_increasing_id()), "va-vectors")
    # a query's own id may be among those of a vector, so k + 1 are kept
    distinct = materialized(candidates(vectors, k + 1).withColumn("cand", F.monotonically_increasing_id())
                            .withColumn("large", F.exists("v", lambda x: F.abs(x) >= LARGEST)), "va-exact")
    best = _small_pairs(vectors.where("not large"), distinct.where("not large"), is_query, k, bits)
    large = not vectors.where("large").isEmpty()
    if large:
        best = best.withColumn("beyond", F.lit(0)).withColumn("key", F.lit(None).cast("binary")) \
            .unionByName(_large_pairs(vectors, distinct, is_query, k))
    order = [F.desc("beyond"), F.desc("score"), F.desc("key")] if large else [F.desc("score")]
    each = best.withColumn("of", F.explode("ids")).withColumn("vec_id", F.col("of.vec_id")).where("vec_id <> query_id")
    # a row for every row of the query's and the candidate's; k are enough
    rows_of = F.least(F.col("times") * F.col("of.times"), F.lit(k)).cast("int")
    each = each.withColumn("nth", F.explode(F.sequence(F.lit(1), rows_of)))
    w = Window.partitionBy("query_id").orderBy(*order, "vec_id")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def _small_pairs(vectors: DataFrame, distinct: DataFrame, is_query, k: int, bits: int) -> DataFrame:
    """(query_id, score, ids, times): the k best vectors per query, by approximations."""
    ends = cells(distinct, bits).groupBy("dim").agg(F.collect_list(F.struct("i", "low", "ends")).alias("cells"))
    coded = materialized(_candidate_blocks(distinct).join(ends, "dim", "left")
                         .select("dim", "n", "ids", "ids2", "ids3", "body", "cells")
                         .mapInArrow(_approximate, _CODED), "va-file")
    met = _met(coded, _query_blocks(vectors.where(is_query)))
    bounds = materialized(met.mapInArrow(_scan(k, _coded_bounds, np.int64), _BOUNDS.format("bigint")), "va-bounds")
    # over all blocks: the k-th lower bound, with ties by the least id
    bar = _per_query(bounds, [F.desc("low"), "least"], k).groupBy("query_id").agg(F.min("low").alias("bar"))
    left = materialized(bounds.join(bar, "query_id").where("high >= bar").select("query_id", "qrow", "cand", "least", "high"),
                        "va-left")
    head = _per_query(left, [F.desc("high"), "least"], k)
    sure = materialized(_exact(head, vectors, distinct), "va-head")
    reached = _per_query(sure, [F.desc("score"), "least"], k).groupBy("query_id").agg(F.min("score").alias("reached"))
    rest = left.join(head.select("qrow", "cand"), ["qrow", "cand"], "left_anti") \
        .join(reached, "query_id").where("high >= reached").select("query_id", "qrow", "cand", "least", "high")
    scored = sure.unionByName(_exact(rest, vectors, distinct))
    return _per_query(scored, [F.desc("score"), "least"], k).select("query_id", "score", "ids", "times")


def _pairs(pairs: DataFrame, vectors: DataFrame, distinct: DataFrame) -> DataFrame:
    met = pairs.join(distinct.select("cand", "ids", "v"), "cand").join(vectors.select("qrow", "times", F.col("v").alias("qv")), "qrow")
    return met.select("query_id", "qrow", "cand", "least", "ids", "times", "qv", "v")


def _exact(pairs: DataFrame, vectors: DataFrame, distinct: DataFrame) -> DataFrame:
    """(query_id, cand, least, ids, times, score) with the exact inner product."""
    product = F.aggregate(F.zip_with("qv", "v", lambda a, b: a.cast("bigint") * b.cast("bigint")),
                          F.lit(0).cast("bigint"), lambda s, x: s + x)
    return _pairs(pairs, vectors, distinct).select("query_id", "cand", "least", "ids", "times", product.alias("score"))


_MOST = (1 << 63) - 1
_KEY_BYTES = 272   # products of doubles are under 2**2048, and sums have room


def _integers(batches):
    """Exact inner products: the score within 64 bits, on which side it lies
    beyond them, and then its exact value as bytes in the order of values."""
    for b in batches:
        scores = [sum(int(x) * int(y) for x, y in zip(q, v))
                  for q, v in zip(b.column("qv").to_pylist(), b.column("v").to_pylist())]
        beyond = [(s > _MOST) - (s < -_MOST) for s in scores]
        shift = 1 << (8 * _KEY_BYTES - 1)
        yield pa.RecordBatch.from_arrays(
            [b.column("query_id"), b.column("least"), b.column("ids"), b.column("times"),
             pa.array([max(-_MOST, min(_MOST, s)) for s in scores], pa.int64()), pa.array(beyond, pa.int32()),
             pa.array([(s + shift).to_bytes(_KEY_BYTES, "big") if o else None for s, o in zip(scores, beyond)], pa.binary())],
            ["query_id", "least", "ids", "times", "score", "beyond", "key"])


def _large_pairs(vectors: DataFrame, distinct: DataFrame, is_query, k: int) -> DataFrame:
    """(query_id, score, ids, times, beyond, key): the k best vectors per query among
    the pairs of which one vector at least is large."""
    queries = vectors.where(is_query)
    scan, schema = _scan(k, _double_bounds, np.float64), _BOUNDS.format("double")
    sides = [(queries.where("large"), distinct), (queries.where("not large"), distinct.where("large"))]
    found = [_met(_candidate_blocks(c, np.float64), _query_blocks(q, np.float64)).mapInArrow(scan, schema) for q, c in sides]
    bounds = materialized(found[0].unionByName(found[1]), "va-large")
    bar = _per_query(bounds, [F.desc("low"), "least"], k).groupBy("query_id").agg(F.min("low").alias("bar"))
    left = bounds.join(bar, "query_id").where("high >= bar").select("query_id", "qrow", "cand", "least")
    scored = _pairs(left, vectors, distinct).mapInArrow(
        _integers, "query_id bigint, least bigint, ids array<struct<vec_id:bigint,times:bigint>>, times bigint, "
                   "score bigint, beyond int, key binary")
    return _per_query(scored, [F.desc("beyond"), F.desc("score"), F.desc("key"), "least"], k) \
        .select("query_id", "score", "ids", "times", "beyond", "key")
