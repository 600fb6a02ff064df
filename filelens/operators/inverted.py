"""A stored inverted index with block bounds, and BM25 search that skips.

Each scanning task cuts its documents, by length, into blocks of up to
``BLOCK_DOCS`` and emits one row per (term, block): the documents that hold the
term, how often, the greatest count and the least length among them. A block's
documents are a row of their own, without a term. The rows are stored by a hash
of the term and sorted by term; a frequent term has a row per block, so the
write splits it over tasks (rebalanced by size).

A search reads the narrow columns of its words' rows first: the sum over a
query's words of idf x part of the score at the greatest count and least length
bounds every score in a block. The blocks with the highest bounds are scored,
which gives each query a k-th score, and of the others only those whose bound
reaches it. The postings of skipped blocks are never read, and no row is made
per (query, document).

An index may keep the documents' hashed-term vectors too, made in the same
pass over the texts, for the searches that rank by both.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from filelens.functions import text as X
from filelens.operators.common import materialized, maybe_broadcast, spread
from filelens.operators.dense import round_half_up
from filelens.operators.embed import hashed_counts, packed_counts
from filelens.session import scratch_path

BM25_K1 = 1.2
BM25_B = 0.75
BLOCK_DOCS = 512     # documents of a block at most
BATCH_DOCS = 2048    # documents that a task cuts into blocks at once
BUCKETS = 16         # partitions of the postings by term
HASH_PLACES = 1 << 20  # of words, where an index is made for some words only
FIRST_BLOCKS = 2     # blocks that a query scores before it skips, at least
FIRST_DOCS = 32      # documents of them for each one asked for, at least
# Scores have six decimals: a bound this far below a score cannot reach it
_SLACK = 1e-6


def _bucket(term: Column) -> Column:
    """Where a term's rows are stored; those of the documents are in -1, their
    vectors in -2."""
    return F.when(term.isNull(), -1).otherwise(F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int"))


def _postings(block_docs: int, schema: pa.Schema, wanted: np.ndarray | None, dim: int | None):
    """Blocks of each batch: a row per term of a block, and one with the
    block's documents and their lengths. ``wanted``: hash places of the only
    words to store (others may share a place). ``dim``: a row with the vector
    of each text, null or not, too."""
    def run(batches):
        task, blocks = TaskContext.get().partitionId() << 33, 0
        for rb in (b.slice(i, BATCH_DOCS) for b in batches for i in range(0, b.num_rows, BATCH_DOCS)):
            ids, there = rb.column("doc"), rb.column("words").is_valid()
            lens, words, code = X.split_words(rb.column("words"))
            if dim is not None:
                yield pa.RecordBatch.from_arrays(
                    [*(pa.nulls(len(lens), f.type) for f in list(schema)[:-2]), ids.cast(schema.field("doc").type),
                     packed_counts(hashed_counts(lens, words, code, dim))], schema=schema)
            # a null text is no document; it has no words either
            ids, lens = ids.filter(there), lens[there.to_numpy(zero_copy_only=False)]
            if not len(lens):
                continue
            size = max(1, len(words))
            # documents by length: those of a block have scores alike
            order = np.argsort(lens, kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            # a (block, term) has its postings beside each other
            key = (np.repeat(place // block_docs, lens) * size + code) * block_docs + np.repeat(place % block_docs, lens)
            if wanted is not None:
                known = np.array([zlib.crc32(w) for w in words.cast(pa.binary()).to_numpy(zero_copy_only=False)], np.int64)
                key = key[wanted[known % len(wanted)][code]]
            key, tf = np.unique(key, return_counts=True)
            at, group = key % block_docs, key // block_docs
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][:len(group)])
            offs = pa.array(np.r_[first, len(group)].astype(np.int32))
            block, dl = group // size, lens[order][(group // size) * block_docs + at]
            n_terms = len(first)
            none = [pa.nulls(n_terms, f.type) for f in list(schema)[9:]]
            terms = pa.table([
                words.take(pa.array(group[first] % size)) if n_terms else pa.array([], pa.string()),
                pa.array(task + blocks + block[first]), pa.array(np.diff(np.r_[first, len(group)])),
                pa.array((np.maximum.reduceat(tf, first) if n_terms else tf).astype(np.int32)),
                pa.array(np.minimum.reduceat(dl, first) if n_terms else dl),
                pa.ListArray.from_arrays(offs, pa.array(at.astype(np.int32))),
                pa.ListArray.from_arrays(offs, pa.array(tf.astype(np.int32))),
                pa.nulls(n_terms, schema.field("docs").type), pa.nulls(n_terms, pa.list_(pa.int64())), *none], schema=schema)
            yield from terms.to_batches(max_chunksize=1 << 16)
            starts = np.arange(0, len(order), block_docs)
            offs = pa.array(np.r_[starts, len(order)].astype(np.int32))
            made, none = len(starts), pa.nulls(len(starts), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([
                pa.nulls(made, pa.string()), pa.array(task + blocks + np.arange(made)),
                pa.array(np.diff(np.r_[starts, len(order)])), pa.nulls(made, pa.int32()), pa.nulls(made, pa.int64()), none, none,
                pa.ListArray.from_arrays(offs, ids.take(pa.array(order)).cast(schema.field("docs").type.value_type)),
                pa.ListArray.from_arrays(offs, pa.array(lens[order])),
                *(pa.nulls(made, f.type) for f in list(schema)[9:])], schema=schema)
            blocks += made
    return run


def build(docs: DataFrame, root: str | None = None, *, id_col: str = "doc_id", text_col: str = "text",
          only: DataFrame | None = None, dim: int | None = None) -> InvertedIndex:
    """Index ``docs`` under ``root`` (default: a table of the shared scratch
    folder). A null text is no document; a row is a document of its own.
    ``only`` (term): the words of a search that the index is made for; of
    other words only those are stored that share a hash place with one.
    ``dim``: the hashed-term vectors of all rows are stored too, also of
    those without a text (``InvertedIndex.vectors``)."""
    spark = docs.sparkSession
    root = (root or scratch_path(spark, "inverted")).rstrip("/")
    words = spread(docs, id_col).select(F.col(id_col).alias("doc"), X.word_text(text_col).alias("words"))
    i, n = T.IntegerType(), T.LongType()
    schema = T.StructType([T.StructField(c, t) for c, t in (
        ("term", T.StringType()), ("block", n), ("n", n), ("max_tf", i), ("min_dl", n), ("at", T.ArrayType(i)),
        ("tfs", T.ArrayType(i)), ("docs", T.ArrayType(words.schema["doc"].dataType)), ("dls", T.ArrayType(n)),
        *([] if dim is None else [("doc", words.schema["doc"].dataType), ("vec", T.BinaryType())]))])
    wanted = None
    if only is not None:
        # at most HASH_PLACES numbers, however many words there are
        places = only.select((F.crc32(F.col("term").cast("binary")) % HASH_PLACES).alias("p")).distinct().toArrow()
        wanted = np.zeros(HASH_PLACES, bool)
        wanted[places.column("p").to_numpy()] = True
    rows = words.mapInArrow(_postings(BLOCK_DOCS, to_arrow_schema(schema), wanted, dim), schema)
    bucket = _bucket(F.col("term"))
    if dim is not None:
        bucket = F.when(F.col("vec").isNotNull(), -2).otherwise(bucket)
    rows.withColumn("bucket", bucket).hint("rebalance", F.col("bucket")) \
        .sortWithinPartitions("bucket", "term") \
        .write.mode("errorifexists").partitionBy("bucket").option("compression", "zstd").parquet(f"{root}/postings")
    return InvertedIndex(spark, root)


class InvertedIndex:
    """A stored index; every method is a Spark plan over its tables."""

    def __init__(self, spark: SparkSession, root: str, k1: float = BM25_K1, b: float = BM25_B):
        self.spark, self.root, self.k1, self.b = spark, root, k1, b
        table = spark.read.parquet(f"{root}/postings")
        self.documents = table.where("bucket = -1").select("block", "docs", "dls")
        self.postings = table.where("bucket >= 0").drop("docs", "dls", "doc", "vec")
        self.vectors = table.where("bucket = -2").select("doc", "vec") if "vec" in table.columns else None
        self.id_type = table.schema["docs"].dataType.elementType
        words = F.aggregate("dls", F.lit(0).cast("bigint"), lambda x, y: x + y)
        s = self.documents.agg(F.coalesce(F.sum(F.size("docs")), F.lit(0)).alias("n"),
                               F.coalesce(F.sum(words), F.lit(0)).alias("words")).first()
        self.n, self.avgdl = s["n"], s["words"] / s["n"] if s["n"] else 0.0

    def query(self, queries: DataFrame, *, qid_col: str = "query_id", text_col: str = "text") -> Query:
        """The queries' distinct words (a query's words are one row each)."""
        return Query(self, queries.select(F.col(qid_col).cast("bigint").alias("query_id"),
                                          F.explode(F.array_distinct(X.words(text_col))).alias("term")))


class Query:
    """A batch of queries against one index: words with their weights, and a
    bound of the scores in each block, both written once."""

    def __init__(self, index: InvertedIndex, words: DataFrame):
        self.index = index
        words = words.distinct().withColumn("bucket", _bucket(F.col("term")))
        heads = materialized(index.postings.select("bucket", "term", "block", "n", "max_tf", "min_dl").join(
            words.select("bucket", "term").distinct(), ["bucket", "term"]), "query-heads")
        df = heads.groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.log(1.0 + (F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        self.weights = materialized(words.join(df, "term").select("query_id", "bucket", "term", idf.alias("idf")),
                                    "query-weights")
        norm = index.k1 * (1 - index.b + index.b * F.col("min_dl") / F.lit(index.avgdl or 1.0))
        top = F.col("max_tf") * (index.k1 + 1) / (F.col("max_tf") + norm)
        self.bounds = materialized(heads.join(self.weights, ["bucket", "term"]).groupBy("query_id", "block").agg(
            F.sum(top * F.col("idf")).alias("bound")), "query-bounds")

    def _scored(self, pairs: DataFrame, schema: T.StructType, choose) -> DataFrame:
        """``choose`` over the scores of each (query, block) of ``pairs``,
        whose further columns it is given; blocks are one group each."""
        index = self.index
        lists = self.weights.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("w")) \
            .select("query_id", F.col("w.term").alias("terms"), F.col("w.idf").alias("idfs"))
        pairs = materialized(pairs, "query-pairs")
        asked = pairs.join(lists, "query_id")
        blocks = pairs.select(F.col("block").alias("_asked")).distinct()
        mine = F.col("block") == F.col("_asked")
        columns = ["block", "term", "at", "tfs", "docs", "dls"]
        lists = index.postings.join(self.weights.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi") \
            .join(blocks, mine, "left_semi").withColumns(
            {"docs": F.lit(None).cast(T.ArrayType(index.id_type)), "dls": F.lit(None).cast("array<bigint>")})
        docs = index.documents.join(blocks, mine, "left_semi").withColumns(
            {"term": F.lit(None).cast("string"), "at": F.lit(None).cast("array<int>"), "tfs": F.lit(None).cast("array<int>")})
        parts = lists.select(*columns).unionByName(docs.select(*columns))
        run = _block_scorer(choose, index.k1, index.b, index.avgdl, pa.schema(
            [(f.name, to_arrow_type(f.dataType)) for f in schema.fields]))
        return asked.groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(run, schema)

    def _list_schema(self) -> T.StructType:
        return T.StructType([T.StructField("query_id", T.LongType()), T.StructField("doc", self.index.id_type),
                             T.StructField("score", T.DoubleType())])

    def top(self, k: int | None) -> DataFrame:
        """(query_id, rank, doc, score): the k best documents per query with
        at least one of its words; ties by id. ``None``: all of them."""
        first, rest = self.rounds(k)
        found = self._scored(rest, self._list_schema(), _best(k))
        if first is not None:
            found = found.unionByName(first)
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc"))
        ranked = found.withColumn("rank", F.row_number().over(w).cast("bigint"))
        return (ranked if k is None else ranked.where(F.col("rank") <= k)).select("query_id", "rank", "doc", "score")

    def rounds(self, k: int | None) -> tuple[DataFrame | None, DataFrame]:
        """What the blocks with the highest bounds give, and the further
        (query, block, floor) to score. Without a cut there are no bounds to
        beat, and all blocks are further ones."""
        none = F.lit(None).cast("double")
        if k is None:
            return None, self.bounds.select("query_id", "block", none.alias("floor"))
        n_first = _first_blocks(k)
        w = Window.partitionBy("query_id").orderBy(F.desc("bound"), F.asc("block"))
        order = self.bounds.withColumn("nth", F.row_number().over(w))
        heads = order.where(F.col("nth") <= n_first).select("query_id", "block", none.alias("floor"))
        first = materialized(self._scored(heads, self._list_schema(), _best(k)), "query-first")
        by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc"))
        floors = first.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k) \
            .select("query_id", F.col("score").alias("floor"))
        rest = order.where(F.col("nth") > n_first).join(floors, "query_id", "left") \
            .where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - _SLACK))
        return first, rest.select("query_id", "block", "floor")

    def blocks_read(self, k: int | None) -> DataFrame:
        """(query_id, scored, blocks): blocks whose postings a search for k
        reads, of those with a word of the query."""
        _, rest = self.rounds(k)
        more = rest.groupBy("query_id").agg(F.count(F.lit(1)).alias("more"))
        every = self.bounds.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks"))
        head = F.lit(0) if k is None else F.least(F.col("blocks"), F.lit(_first_blocks(k)))
        return every.join(more, "query_id", "left").select(
            "query_id", (head + F.coalesce("more", F.lit(0))).cast("bigint").alias("scored"), "blocks")

    def ranks(self, wanted: DataFrame) -> DataFrame:
        """(query_id, doc, rank): the exact rank of each wanted (query_id, doc)
        in the whole list of its query, without making the list: the blocks
        whose bound reaches the least wanted score count, per wanted document,
        the documents before it. Documents outside the list have no row."""
        where = self.index.documents.select("block", F.explode("docs").alias("doc"))
        asked = where.join(maybe_broadcast(wanted), "doc").groupBy("query_id", "block").agg(F.collect_set("doc").alias("wanted"))
        known = materialized(self._scored(asked, self._list_schema(), _pick), "wanted-scores")
        marks = known.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("score", "doc"))).alias("m"),
                                              F.min("score").alias("least"))
        reach = self.bounds.join(marks, "query_id").where(F.col("bound") >= F.col("least") - _SLACK) \
            .select("query_id", "block", F.col("m.score").alias("at"), F.col("m.doc").alias("marks"))
        schema = T.StructType([*self._list_schema().fields[:2], T.StructField("before", T.LongType())])
        counted = self._scored(reach, schema, _before)
        return counted.groupBy("query_id", "doc").agg((F.sum("before") + 1).alias("rank"))


def _first_blocks(k: int) -> int:
    """A long list needs more documents before its last score skips any."""
    return max(FIRST_BLOCKS, -(-k * FIRST_DOCS // BLOCK_DOCS))


def _best(k: int | None):
    def choose(ask: dict, docs: np.ndarray, score: np.ndarray):
        keep = np.flatnonzero(score > 0 if ask["floor"] is None else score >= max(ask["floor"], _SLACK / 2))
        if k is not None and len(keep) > k:
            keep = keep[np.lexsort((docs[keep], -score[keep]))[:k]]
        return docs[keep], score[keep]
    return choose


def _pick(ask: dict, docs: np.ndarray, score: np.ndarray):
    keep = np.flatnonzero(np.isin(docs, np.array(ask["wanted"])) & (score > 0))
    return docs[keep], score[keep]


def before_marks(marks: np.ndarray, mark_ids: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """How many of the scored rows come before each mark (score, id) by score
    descending, id ascending. Marks are sorted by score."""
    at = np.unique(marks)
    place = np.searchsorted(at, score)
    above = np.bincount(place, minlength=len(at) + 1)
    # rows at a mark's own score are settled by id
    tie = (place < len(at)) & (at[np.minimum(place, len(at) - 1)] == score)
    beyond = np.cumsum(above[::-1])[::-1]
    mine = np.searchsorted(at, marks)
    out = beyond[mine + 1].copy()
    for p in np.unique(place[tie]):
        mark = np.flatnonzero(mine == p)
        out[mark] += np.searchsorted(np.sort(ids[tie & (place == p)]), mark_ids[mark])
    return out


def _before(ask: dict, docs: np.ndarray, score: np.ndarray):
    marks, ids = np.array(ask["at"]), np.array(ask["marks"])
    hit = score > 0
    return ids, before_marks(marks, ids, score[hit], docs[hit])


def _block_scorer(choose, k1: float, b: float, avgdl: float, schema: pa.Schema):
    def run(asked: pa.Table, parts: pa.Table) -> pa.Table:
        if not len(asked) or not len(parts):
            return schema.empty_table()
        parts = parts.combine_chunks()
        term = parts["term"].to_pylist()
        head = term.index(None)
        docs = np.array(parts["docs"][head].as_py())
        dl = np.array(parts["dls"][head].as_py(), np.float64)
        at, tf = (parts[c].chunk(0).flatten().to_numpy(zero_copy_only=False) for c in ("at", "tfs"))
        tf = tf.astype(np.float64)
        weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[at] / avgdl))
        ends = np.cumsum(pc.fill_null(pc.list_value_length(parts["at"]), 0).to_numpy(zero_copy_only=False)).tolist()
        lists = {t: (at[a:z], weight[a:z]) for t, a, z in zip(term, [0, *ends], ends) if t is not None}
        qids, found, values = [], [], []
        for ask in asked.to_pylist():
            got = [(lists[t], w) for t, w in zip(ask["terms"], ask["idfs"]) if t in lists]
            if not got:
                continue
            # words in order, so that a score is the same in every round
            score = round_half_up(np.bincount(np.concatenate([p[0] for p, _ in got]), minlength=len(docs),
                                              weights=np.concatenate([p[1] * w for p, w in got])))
            ids, value = choose(ask, docs, score)
            qids.append(np.full(len(ids), ask["query_id"]))
            found.append(ids)
            values.append(value)
        if not found:
            return schema.empty_table()
        return pa.table([pa.array(np.concatenate(qids)), pa.array(np.concatenate(found).tolist(), schema.field(1).type),
                         pa.array(np.concatenate(values), schema.field(2).type)], schema=schema)
    return run
