"""Near-duplicates by BagMinHash over multisets of word shingles.

A text is the multiset of its windows of five words (a shorter text is one
window). Every shingle owns Poisson processes over the dyadic intervals [0,1),
[1,2), [2,4), ... of its weight; a point counts if its position is below the
shingle's count. A signature register keeps the least point that falls to it,
so two texts agree in a register with the probability of their weighted
Jaccard similarity, and the work does not grow with the weights. Points are
only made up to a bound that fills every register.

Candidates share a band of registers and are verified on their whole
multisets. A bucket of similar texts is not expanded into pairs: its members
are compared with one hub (the text with most company in all its buckets),
classes are connected components of the verified links, and a round with
hubs between classes follows. What is then still in one bucket but in
different classes is compared exactly, so that no link of a bucket is lost:
small buckets pair by pair, large ones in blocks of at most ``BLOCK`` by
``BLOCK`` texts that emit links only. Texts of the same words are one node
from the start.

Defined cases: null and white-space texts have no shingle and are a class
each; ties keep the least id (nulls last); repeated rows are copies; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filelens.operators.common import materialized

from . import components
from . import textops as X
from .common import col, fresh

WORDS = 5
THRESHOLD = (4, 5)   # similarity 0.8 as a fraction, for exact comparison
BANDS, ROWS = 24, 4  # a pair at 0.8 is missed with probability 3e-6
STAR_ROUNDS = 2
SMALL, BLOCK = 24, 512  # buckets compared pair by pair; texts in one block otherwise

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def shingles(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, hash, count) of the distinct shingles of each text, ordered by
    row and hash, then per row the number of words and 128 bits of the text's
    word sequence."""
    n = len(offs) - 1
    starts, ends = X.word_spans(buf, offs)
    rows = X.rows_of(starts, offs)
    words = X.span_hashes(buf, starts, ends)
    n_words = np.bincount(rows, minlength=n)
    first = np.cumsum(n_words) - n_words
    up, _ = X._power_tables(int(n_words.max(initial=0)) + 1)
    place = up[np.arange(len(words)) - first[rows]]
    full = np.flatnonzero(n_words)
    seq = np.zeros((2, n), _U)
    for k in range(2):
        if len(full):
            seq[k, full] = X.mix64(np.add.reduceat(X.mix64(words + _U(k) * _GOLD) * place, first[full])
                                   + n_words[full].astype(_U))
    at, grams = X.ngram_hashes(words, rows, WORDS)
    short = np.flatnonzero((n_words > 0) & (n_words < WORDS))
    r = np.concatenate([rows[at], short])
    h = np.concatenate([grams, seq[0, short]])
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    i = np.flatnonzero(new)
    return r[i], h[i], np.diff(np.append(i, len(h))), n_words, seq


def signatures(rows: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n: int,
               registers: int = BANDS * ROWS) -> np.ndarray:
    """BagMinHash signatures (n x registers) of weighted sets; rows without
    elements stay infinite."""
    # dyadic intervals: number 0 is [0, 1), number j is [2**(j-1), 2**j)
    top = np.ceil(np.log2(counts)).astype(np.int64)
    e = np.repeat(np.arange(len(counts)), top + 1)
    level = np.arange(len(e)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    begin = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0)).astype(np.float64)
    size = np.where(level == 0, 1, 1 << np.maximum(level - 1, 0)).astype(np.float64)
    seed = X.mix64(hashes[e] ^ X.mix64(level.astype(_U) + _GOLD))
    row, weight = rows[e], counts[e].astype(np.float64)
    total = np.bincount(rows, weights=counts, minlength=n)
    out = np.full((n, registers), np.inf)
    todo = np.flatnonzero(total)
    slack = 4.0
    while len(todo):
        bound = np.full(n, -1.0)
        # all registers are filled with probability 1 - exp(-slack) or so
        bound[todo] = registers * (np.log(registers) + slack) / total[todo]
        live = np.flatnonzero(bound[row] > 0)
        x = np.zeros(len(live))
        t, block = 0, 1
        while len(live):
            # the next ``block`` points of every live process
            k = _U(t + 1) + np.arange(block, dtype=_U)
            a = X.mix64(seed[live][:, None] + k[None, :] * _GOLD)
            gap = -np.log(((a >> _U(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / size[live][:, None]
            points = x[:, None] + np.cumsum(gap, axis=1)
            b = X.mix64(a ^ _GOLD)
            register = ((b >> _U(40)) % _U(registers)).astype(np.int64)
            spot = begin[live][:, None] + (b & _U((1 << 40) - 1)).astype(np.float64) * 2.0 ** -40 * size[live][:, None]
            ok = (points <= bound[row[live]][:, None]) & (spot < weight[live][:, None])
            i, j = np.nonzero(ok)
            np.minimum.at(out, (row[live][i], register[i, j]), points[i, j])
            x = points[:, -1]
            t += block
            more = x <= bound[row[live]]
            live, x = live[more], x[more]
            block = min(block * 2, max(1, 2_000_000 // max(1, len(live))), 256)
        todo = todo[np.isinf(out[todo]).any(axis=1)]
        slack += 12.0
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band (n x bands), different for every band."""
    bits = sig.view(_U).reshape(len(sig), bands, -1)
    key = np.broadcast_to(X.mix64(np.arange(bands, dtype=_U) + _GOLD), bits.shape[:2]).copy()
    for k in range(bits.shape[2]):
        key = X.mix64(key * _GOLD + bits[:, :, k])
    return key


_SIGNED = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()),
                        T.StructField("weight", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


@F.arrow_udf(_SIGNED)
def signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Word-sequence hash, number of shingles and band keys of every text."""
    for texts in batches:
        parts = []
        for _, _, buf, offs in X.text_slices(texts):
            r, h, c, n_words, seq = shingles(buf, offs)
            keys = band_keys(signatures(r, h, c, len(n_words))).view(np.int64)
            has = n_words > 0
            weight = np.where(has, np.maximum(n_words - WORDS + 1, 1), 0)
            offsets = np.concatenate([[0], np.cumsum(has * BANDS)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[has].ravel(), pa.int64()))
            parts.append(pa.StructArray.from_arrays(
                [pa.array(seq[0].view(np.int64)), pa.array(seq[1].view(np.int64)),
                 pa.array(weight, pa.int64()), lists], ["h1", "h2", "weight", "bands"]))
        yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(
            [("h1", pa.int64()), ("h2", pa.int64()), ("weight", pa.int64()), ("bands", pa.list_(pa.int64()))]))


def _packed(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """One binary of 64-bit words per row."""
    offs = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]) * 8
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), n, [None, pa.py_buffer(offs.astype(np.int64)),
                               pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _sets(batches):
    """(k, text, bands) -> (k, bands, hashes, counts): packed sorted shingles."""
    for b in batches:
        for lo, hi, buf, offs in X.text_slices(b.column("text")):
            r, h, c, _, _ = shingles(buf, offs)
            yield pa.RecordBatch.from_arrays(
                [b.column("k").slice(lo, hi - lo), b.column("bands").slice(lo, hi - lo), _packed(r, h, hi - lo),
                 _packed(r, c.astype(np.int64), hi - lo)], ["k", "bands", "hashes", "counts"])


def _similar(batches):
    """Verified pairs: (a, b, overlap, total) with overlap / total at least
    the threshold."""
    num, den = THRESHOLD
    for b in batches:
        keep, over, union = [], [], []
        cols = [b.column(c) for c in ("ha", "ca", "hb", "cb")]
        last, ha, ca = None, None, None
        for i in range(b.num_rows):
            raw = cols[0][i].as_buffer()
            if last is None or raw != last:
                ha, ca, last = np.frombuffer(raw, _U), np.frombuffer(cols[1][i].as_buffer(), np.int64), raw
            hb, cb = np.frombuffer(cols[2][i].as_buffer(), _U), np.frombuffer(cols[3][i].as_buffer(), np.int64)
            at = np.minimum(np.searchsorted(ha, hb), len(ha) - 1)
            same = ha[at] == hb
            o = int(np.minimum(ca[at[same]], cb[same]).sum())
            u = int(ca.sum() + cb.sum()) - o
            if den * o >= num * u:
                keep.append(i)
                over.append(o)
                union.append(u)
        rows = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("a").take(rows), b.column("b").take(rows),
                                          pa.array(over, pa.int64()), pa.array(union, pa.int64())],
                                         ["a", "b", "overlap", "total"])


def _near_size(a, b):
    num, den = THRESHOLD
    return F.least(a, b) * den >= F.greatest(a, b) * num


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose multisets reach the threshold, written."""
    sa = sets.select(F.col("k").alias("a"), F.col("hashes").alias("ha"), F.col("counts").alias("ca"))
    sb = sets.select(F.col("k").alias("b"), F.col("hashes").alias("hb"), F.col("counts").alias("cb"))
    both = pairs.join(sb, "b").join(sa, "a")
    return materialized(both.mapInArrow(_similar, "a bigint, b bigint, overlap bigint, total bigint"), "bmh-links")


def _star(members: DataFrame, seed: int) -> DataFrame:
    """Pairs (a, b) between each bucket's hub and one member of each other
    class in the bucket: those with most company, ties at random."""
    rank = F.struct((-F.col("company")).alias("c"), F.xxhash64("k", F.lit(seed)).alias("p"), F.col("k"), F.col("weight"))
    one = members.groupBy("bucket", "class").agg(F.min(rank).alias("m"))
    hub = one.groupBy("bucket").agg(F.min("m").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return one.join(hub, "bucket").where((F.col("m.k") != F.col("hub.k")) & _near_size(F.col("m.weight"), F.col("hub.weight"))) \
        .select(F.col("hub.k").alias("a"), F.col("m.k").alias("b")).distinct()


def _small_pairs(left: DataFrame) -> DataFrame:
    """All pairs of different classes in buckets of bounded size."""
    few = left.where(F.col("n") <= SMALL).select("bucket", "k", "class", "weight")
    other = few.select("bucket", *[F.col(c).alias(f"{c}2") for c in ("k", "class", "weight")])
    return few.join(other, "bucket").where(
        (F.col("class") < F.col("class2")) & _near_size(F.col("weight"), F.col("weight2"))) \
        .select(F.col("k").alias("a"), F.col("k2").alias("b")).distinct()


def _block_links(table: pa.Table) -> pa.Table:
    """Links between the probes and the targets of one block of a bucket. A
    pair is compared in the first band that it shares, and a probe stops at
    its first link to a class."""
    num, den = THRESHOLD
    probe = table.column("probe").to_numpy(zero_copy_only=False).astype(bool)
    k, cls, weight, major = (table.column(c).to_numpy() for c in ("k", "class", "weight", "major"))
    bands = np.array(table.column("bands").to_pylist(), np.int64)
    band = int(np.flatnonzero(bands[0] == table.column("bucket")[0].as_py())[0])
    sets = [(np.frombuffer(h.as_buffer(), _U), np.frombuffer(c.as_buffer(), np.int64))
            for h, c in zip(table.column("hashes"), table.column("counts"))]
    links = []
    t = np.flatnonzero(~probe)
    for i in np.flatnonzero(probe):
        near = np.minimum(weight[t], weight[i]) * den >= np.maximum(weight[t], weight[i]) * num
        once = (cls[t] == major[t]) | (k[t] > k[i])
        first = ~(bands[t, :band] == bands[i, :band]).any(axis=1)
        todo = t[near & once & first & (cls[t] != cls[i])]
        h, c = sets[i]
        done = set()
        for lo in range(0, len(todo), 32):
            part = [j for j in todo[lo:lo + 32] if cls[j] not in done]
            if not part:
                continue
            them = np.concatenate([sets[j][0] for j in part])
            theirs = np.concatenate([sets[j][1] for j in part])
            at = np.minimum(np.searchsorted(h, them), len(h) - 1)
            both = np.where(h[at] == them, np.minimum(c[at], theirs), 0)
            over = np.add.reduceat(both, np.cumsum([0] + [len(sets[j][0]) for j in part[:-1]]))
            for j, o in zip(part, over.tolist()):
                if den * o >= num * (weight[i] + weight[j] - o):
                    links.append((k[i], k[j]))
                    done.add(cls[j])
    a, b = zip(*links) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _large_links(left: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between classes in large buckets: every member outside the
    bucket's largest class (a probe) against all members, in blocks."""
    many = left.where(F.col("n") > SMALL)
    across = F.ceil(F.col("n") / BLOCK)
    down = F.ceil((F.col("n") - F.col("most")) / BLOCK)
    own = F.xxhash64("k")
    keys = ["bucket", "k", "class", "weight", "major"]
    target = many.select(*keys, F.lit(False).alias("probe"), F.pmod(own, across).alias("col"),
                         F.explode(F.sequence(F.lit(0).cast("bigint"), down - 1)).alias("row"))
    probe = many.where(F.col("class") != F.col("major")).select(
        *keys, F.lit(True).alias("probe"), F.explode(F.sequence(F.lit(0).cast("bigint"), across - 1)).alias("col"),
        F.pmod(own, down).alias("row"))
    full = target.unionByName(probe.select(target.columns)).join(sets, "k")
    return full.groupBy("bucket", "col", "row").applyInArrow(_block_links, "a bigint, b bigint")


def _merged(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(k, class) after the classes that ``links`` (a, b) join are one; the
    components are those of the graph of classes, which shrinks every time."""
    ends = links.join(nodes.select(F.col("k").alias("a"), F.col("class").alias("u")), "a") \
        .join(nodes.select(F.col("k").alias("b"), F.col("class").alias("v")), "b").where("u <> v")
    roots = materialized(components.connected(ends, "u", "v"), "bmh-roots")
    return materialized(nodes.join(roots, F.col("class") == F.col("node"), "left")
                        .select("k", F.coalesce("root", "class").alias("class")), "bmh-classes")


def classify(texts: DataFrame) -> DataFrame:
    """(k, doc_id, class) for a written table (k, doc_id, text, s) with a unique
    row key and ``s = signed(text)``: rows of a class are near-duplicates by
    links of at least the threshold. ``class`` is a row key."""
    rows = texts.select("k", "doc_id", "s.h1", "s.h2", "s.weight")
    reps = materialized(rows.where("weight > 0").groupBy("h1", "h2").agg(F.min("k").alias("rep")), "bmh-reps")
    nodes = texts.select("k", "s.weight", "s.bands").join(reps.select(F.col("rep").alias("k")), "k")
    banded = nodes.select("k", "weight", F.explode("bands").alias("bucket"))
    shared = materialized(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "bmh-buckets")
    members = materialized(banded.join(shared, "bucket"), "bmh-members")
    company = materialized(members.groupBy("k").agg(F.sum("size").alias("company")), "bmh-company")
    members = members.drop("size").join(company, "k")
    sets = materialized(
        texts.select("k", "text", "s.bands").join(company.select("k"), "k", "left_semi")
        .mapInArrow(_sets, "k bigint, bands array<bigint>, hashes binary, counts binary"), "bmh-sets")
    classes = company.select("k", F.col("k").alias("class"))
    for seed in range(STAR_ROUNDS):
        now = members.join(classes, "k")
        classes = _merged(classes, verify(_star(now, seed), sets).select("a", "b"))
    now = materialized(members.join(classes, "k"), "bmh-now")
    per = now.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("c")).groupBy("bucket").agg(
        F.sum("c").alias("n"), F.max(F.struct("c", "class")).alias("m"), F.count(F.lit(1)).alias("classes"))
    mixed = materialized(per.where("classes > 1").select(
        "bucket", "n", F.col("m.c").alias("most"), F.col("m.class").alias("major")), "bmh-mixed")
    left = materialized(now.join(mixed, "bucket"), "bmh-left")
    links = verify(_small_pairs(left), sets).select("a", "b") \
        .unionByName(materialized(_large_links(left, sets), "bmh-links"))
    classes = _merged(classes, links).withColumnRenamed("k", "node")
    node = rows.join(reps, ["h1", "h2"], "left").select("k", "doc_id", F.coalesce("rep", "k").alias("rep"))
    return node.join(classes, F.col("rep") == F.col("node"), "left") \
        .select("k", "doc_id", F.coalesce("class", "rep").alias("class"))


def _table(docs: DataFrame, key: str, s: str) -> DataFrame:
    return materialized(docs.withColumn(s, signed(col("text"))).withColumn(key, F.monotonically_increasing_id()),
                        "bmh-texts")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size, kept) per row of ``docs`` (doc_id, text):
    ``class_id`` is the class's least doc_id, and ``kept`` is true for one row
    of each class, that of ``class_id``."""
    texts = _table(docs.select(col("doc_id"), col("text")), "k", "s")
    found = materialized(classify(texts), "bmh-found")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("k"))).alias("first")
    per = found.groupBy("class").agg(first, F.count(F.lit(1)).alias("class_size"))
    return found.join(per, "class").select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size",
                                           (F.col("first.k") == F.col("k")).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, all columns."""
    key, s = fresh("bmh_row", docs), fresh("bmh_signed", docs)
    texts = _table(docs, key, s)
    found = materialized(classify(texts.select(col(key).alias("k"), col("doc_id"), col("text"), col(s).alias("s"))),
                         "bmh-found")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("k"))).alias("first")
    kept = found.groupBy("class").agg(first).select(F.col("first.k").alias(key))
    return texts.join(kept, key, "left_semi").select(*[col(c) for c in docs.columns])
