"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points run through the sources' cumulative weights, so that every
prefix of the schedule is close to the targets; a source's r-th slot takes its
r-th block. A source's documents are shuffled by hash and concatenated, and
its blocks are ``block`` words each (the last one is what is left); after the
last block the source starts again. A slot takes a whole block, and only a
source's last slot is cut, so that the source ends on its target.

No step keeps a source in one task: positions and ranks are prefix sums in two
passes (within hash buckets or stretches of slots, then over their totals).

Defined cases: a null source is a source of its own (last in order); a null or
white-space text has size 0 and is not taken; repeated rows are documents of
their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filelens.operators.common import global_rank, materialized

from .common import WORD, col, fresh

WEIGHTS = (3, 1, 2)      # by rank of the source, repeating
TOTAL_SHARE = 1.5        # of the sum of all sizes
MAX_REPEATS = 2          # a target stops at so many times its source's size
BLOCK = 1024             # words of a slot
STRETCH = 4096           # slots, and documents on average, of one prefix-sum unit
_GOLDEN, _MODULUS = 1327217885, 1 << 31  # odd multiplier near 2**31 / golden ratio
_HASHES = 1 << 40


def sizes(docs: DataFrame, key: str) -> DataFrame:
    """(key, doc_id, source, size, content hash) of every row, with a row key; written."""
    rows = docs.select(col("doc_id"), col("source"), F.xxhash64(col("text")).alias("content"),
                       F.coalesce(F.regexp_count(col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    return materialized(rows.withColumn(key, F.monotonically_increasing_id()), "mix-sizes")


def targets(rows: DataFrame, weights: tuple = WEIGHTS, total_share: float = TOTAL_SHARE,
            max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(sid, source, source_size, target, quota): water filling. The level
    rises until no source is above its stop; each round is one small
    aggregate, and only its two sums reach the driver."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(per, [F.col("source").asc_nulls_last()], "sid")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1)
                     .cast("int"))
    stop = F.col("source_size") * float(max_repeats)
    ranked = materialized(ranked.withColumn("w", w).withColumn("stop", stop), "mix-sources")
    first = ranked.agg(F.sum("source_size").alias("s"), F.sum("w").alias("w")).first()
    total, level, full = total_share * (first["s"] or 0), 0.0, -1
    if first["w"]:
        level = total / first["w"]
    while level > 0:
        above = F.col("w") * level > F.col("stop")
        r = ranked.agg(F.sum(F.when(above, F.col("stop")).otherwise(0.0)).alias("stopped"),
                       F.sum(F.when(above, 0.0).otherwise(F.col("w"))).alias("w"),
                       F.sum(above.cast("long")).alias("n")).first()
        if r["n"] == full or not r["w"]:
            break
        full, level = r["n"], (total - r["stopped"]) / r["w"]
    return ranked.select("sid", "source", "source_size",
                         F.least(F.col("w") * level, F.col("stop")).alias("target")) \
        .withColumn("quota", F.round("target").cast("long"))


def _slot_needs(sources: DataFrame, block: int) -> DataFrame:
    """Per source with a quota: blocks, slots it needs, words of its last slot
    and where its bracket of the schedule begins."""
    b, s, q = F.lit(block), F.col("source_size"), F.col("quota")
    rest = q % s
    need = sources.where("quota > 0").select(
        "sid", F.ceil(s / b).alias("blocks"),
        (F.floor(q / s) * F.ceil(s / b) + F.ceil(rest / b)).alias("slots"),
        F.when(rest % b > 0, rest % b).alias("cut"))
    return global_prefix(need, "sid", "slots", "begin")


def global_prefix(rows: DataFrame, order: str, amount: str, name: str) -> DataFrame:
    """Exclusive prefix sums of a table in the order of a unique key, in two
    passes over range partitions."""
    sorted_rows = materialized(
        rows.orderBy(order).withColumn("_pid", F.spark_partition_id()), "prefix-rows")
    w = Window.partitionBy("_pid").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    bases = sorted_rows.groupBy("_pid").agg(F.sum(amount).alias("_t")).select(
        "_pid", F.coalesce(F.sum("_t").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)).alias("_b"))  # one row per range partition
    return sorted_rows.withColumn("_in", F.coalesce(F.sum(amount).over(w), F.lit(0))) \
        .join(F.broadcast(bases), "_pid").withColumn(name, F.col("_b") + F.col("_in")).drop("_pid", "_in", "_b")


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, sid, rank, block_no, words): the slots in order. ``words`` is
    null but in a source's last slot if that one is cut.

    The points give a source its slots to within a few; those past its need
    are void, and a source short of some gets them after the last point."""
    spark = sources.sparkSession
    need = materialized(_slot_needs(sources, block), "mix-needs")
    n = need.agg(F.sum("slots")).first()[0] or 0
    width = max(1, n // STRETCH)
    brackets = need.select("sid", "begin", "slots", F.explode(
        F.sequence(F.floor(F.col("begin") / width), F.floor((F.col("begin") + F.col("slots") - 1) / width))).alias("cell"))
    # a point's place: multiples of the golden ratio modulo one, times the slots
    turn = (F.col("slot") % _MODULUS) * _GOLDEN % _MODULUS
    points = spark.range(n).withColumnRenamed("id", "slot") \
        .withColumn("place", F.least(F.floor((turn + 0.5) / _MODULUS * n), F.lit(n - 1))) \
        .withColumn("cell", F.floor(F.col("place") / width))
    hits = points.join(brackets, "cell").where(
        (F.col("place") >= F.col("begin")) & (F.col("place") < F.col("begin") + F.col("slots"))) \
        .select("slot", "sid", F.floor(F.col("slot") / STRETCH).alias("stretch"))
    near = Window.partitionBy("sid", "stretch").orderBy("slot")
    hits = materialized(hits.withColumn("local", F.row_number().over(near) - 1), "mix-hits")
    counts = hits.groupBy("sid", "stretch").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("sid").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranked = hits.join(counts, ["sid", "stretch"]).select("slot", "sid", (F.col("base") + F.col("local")).alias("rank"))
    got = counts.groupBy("sid").agg(F.sum("n").alias("got"))
    short = need.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots") \
        .select("sid", F.explode(F.sequence("got", F.col("slots") - 1)).alias("rank")) \
        .select((F.lit(n) + F.col("rank")).alias("slot"), "sid", "rank")
    return ranked.unionByName(short).join(need.select("sid", "blocks", "slots", "cut"), "sid") \
        .where("rank < slots").select(
            "slot", "sid", "rank", (F.col("rank") % F.col("blocks")).alias("block_no"),
            F.when(F.col("rank") == F.col("slots") - 1, F.col("cut")).alias("words"))


def places(rows: DataFrame, key: str) -> DataFrame:
    """(key, sid, size, at): each document's first word in the shuffled stream
    of its source; documents without words have no place."""
    n = rows.count()
    buckets = 1 << max(0, (n // STRETCH).bit_length())
    # rows without an id, or of one id, are dealt by their texts
    h = F.pmod(F.xxhash64("doc_id", "size", "content"), F.lit(_HASHES))
    full = rows.where("size > 0").withColumn("_h", h).withColumn("_b", F.floor(F.col("_h") / (_HASHES // buckets)))
    inner = Window.partitionBy("sid", "_b").orderBy("_h", "doc_id", "size", key) \
        .rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("sid").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = full.groupBy("sid", "_b").agg(F.sum("size").alias("_t")).select(
        "sid", "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    return full.withColumn("_in", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(bases, ["sid", "_b"]) \
        .select(key, "sid", "size", (F.col("_base") + F.col("_in")).alias("at"))


def mix(docs: DataFrame, block: int = BLOCK, key: str = "_row") -> DataFrame:
    """(key, doc_id, source, size, source_size, target, taken) per row of
    ``docs`` (doc_id, text, source): the words that the mix takes of it."""
    rows = sizes(docs, key)
    return taken(rows, materialized(targets(rows), "mix-targets"), block, key)


def taken(rows: DataFrame, sources: DataFrame, block: int, key: str) -> DataFrame:
    known = materialized(rows.join(sources.select("sid", F.col("source").alias("_s")),
                                   F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "mix-rows")
    per_block = schedule(sources, block).groupBy("sid", "block_no").agg(
        F.sum(F.col("words").isNull().cast("long")).alias("whole"), F.max("words").alias("cut"))
    at, size = F.col("at"), F.col("size")
    pieces = places(known, key).select(
        key, "sid", "at", "size",
        F.explode(F.sequence(F.floor(at / block), F.floor((at + size - 1) / block))).alias("block_no"))
    a = F.greatest(at - F.col("block_no") * block, F.lit(0))
    b = F.least(at + size - F.col("block_no") * block, F.lit(block))
    part = pieces.join(per_block, ["sid", "block_no"]).select(
        key, (F.col("whole") * (b - a)
              + F.greatest(F.least(F.coalesce(F.col("cut"), F.lit(0)), b) - a, F.lit(0))).alias("_taken"))
    return known.join(part.groupBy(key).agg(F.sum("_taken").alias("_taken")), key, "left") \
        .join(sources.select("sid", "source_size", "target"), "sid") \
        .select(key, "doc_id", "source", "size", "source_size", "target",
                F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))


def mixture(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: whole documents, each as
    often as the nearest number to its taken words over its size (a source
    ends inside one document only)."""
    key = fresh("mix_row", docs)
    numbered = materialized(docs.withColumn(key, F.monotonically_increasing_id()), "mix-docs")
    counted = numbered.select(
        col("doc_id"), col("source"), key, F.xxhash64(col("text")).alias("content"),
        F.coalesce(F.regexp_count(col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = materialized(counted, "mix-sizes")
    copies = taken(rows, materialized(targets(rows), "mix-targets"), block, key) \
        .where("size > 0").select(key, F.round(F.col("taken") / F.col("size")).cast("int").alias("mix_copies")) \
        .where("mix_copies > 0")
    times = fresh("mix_copies", docs)
    out = numbered.join(copies.withColumnRenamed("mix_copies", times), key)
    return out.select(*[col(c) for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times)))) \
        .select(*[col(c) for c in docs.columns])
