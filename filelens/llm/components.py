"""Connected components of an edge list, distributed.

Every round each node joins its neighbour of least priority (one aggregate
with map-side minima, so a node with many edges is no hot task), chains of
such choices are halved by a pointer jump, and the edges are contracted to the
chosen representatives. In the first round the nodes with most edges go first,
which settles stars at once; then priorities are random, which shrinks the
graph by a constant factor a round whatever its shape. Rounds end when no edge
is left. Each round's tables are written to the shared folder; the driver only
sees counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelens.operators.common import materialized


def _least(node, seed: int):
    """Sort key of a node in one round: random priority, then the node."""
    return F.struct(F.xxhash64(node, F.lit(seed)).alias("p"), node.alias("v"))


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``edges``; all nodes of a component have
    one root, which is one of them. Loops and repeated edges do no harm;
    rows with a null end are ignored."""
    live = materialized(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
                        .where("u is not null and v is not null").distinct(), "cc-edges")
    maps, seed = [], 0
    while True:
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if seed == 0:
            degree = materialized(both.groupBy("u").agg((-F.count(F.lit(1))).alias("d")), "cc-degrees")
            rank = F.struct(F.col("d"), _least(F.col("v"), seed).alias("l"))
            pick = both.join(degree.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min(rank).alias("m")) \
                .join(degree, "u").select("u", F.least("m", F.struct("d", _least(F.col("u"), seed).alias("l")))["l"].alias("m"))
        else:
            pick = both.groupBy("u").agg(F.min(_least(F.col("v"), seed)).alias("m")) \
                .select("u", F.least("m", _least(F.col("u"), seed)).alias("m"))
        parent = pick.select(F.col("u").alias("node"), F.col("m.v").alias("root"))
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("up"))
        parent = materialized(parent.join(up, "root").select("node", F.col("up").alias("root")), "cc-parents")
        maps.append(parent)
        pu = parent.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        pv = parent.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        live = materialized(live.where("u <> v").join(pu, "u").select("v", "ru").join(pv, "v").where("ru <> rv")
                            .select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(),
                            "cc-edges")
        seed += 1
        if live.isEmpty():
            break
    out = maps.pop()
    while maps:
        later = out.select(F.col("node").alias("root"), F.col("root").alias("later"))
        out = maps.pop().join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
    return out


def classes(edges: DataFrame, a: str, b: str, name: str = "class_id") -> DataFrame:
    """(node, class): as :func:`connected`, the class being its least node."""
    found = materialized(connected(edges, a, b), "cc-roots")
    least = found.groupBy("root").agg(F.min("node").alias(name))
    return found.join(least, "root").select("node", name)
