"""LM scoring by cross-entropy difference.

Two bigram models, of a target corpus and of the background (all documents),
share one vocabulary: words, histories and word pairs are counted by their
full 64-bit hashes, so that the models grow with the corpus and unrelated
pairs share no counter. Both are smoothed alike (a pair model with a Dirichlet
prior on the unigram model, add-one below; the vocabulary is the number of
distinct words, and ``2**VOCAB_BITS`` at least). A document's score is the mean
over its words of target loss minus background loss: the lower, the more it is
like the target. Each document is scored by models of all the others: its own
counts are taken out first.

Texts become blocks of about ``BLOCK_BYTES``: the block's distinct words and a
number per word. Which documents are of the target is found by a narrow join
of ids. A block's distinct keys are dealt to buckets of the hash range, as
many as the corpus needs; a bucket sums the counts of all blocks and answers
each block with the totals of its own keys, by which the block is scored. A
word's count as a history is its count less that at the ends of texts, so
histories need no keys of their own. No count table is broadcast or passes through the driver, and a key takes one
place per block however frequent it is.

Defined cases: a null or white-space text has no words and null losses;
repeated rows count and score once per row; a document with several labels is
of the target if any says so; without any target text the target model is
uniform; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelens.operators.common import materialized

from . import textops as X
from .common import col

VOCAB_BITS = 18
PRIOR = 50.0   # words' worth of the unigram model in a pair estimate
BLOCK_BYTES = 8 << 20
BUCKET_KEYS = 1 << 21   # keys of all blocks that one bucket sums, about
_U = np.uint64
_BEGIN = X.mix64(np.array([7], _U))[0]


def _pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return X.mix64(before * _U(0x9E3779B97F4A7C15) + word)


def word_classes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, hash of the word, hash of the word before, pair hash) per
    word; a text begins with a mark of its own."""
    starts, ends = X.word_spans(buf, offs)
    rows = X.rows_of(starts, offs)
    h = X.span_hashes(buf, starts, ends)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    new = np.ones(len(h), bool)
    new[1:] = rows[1:] != rows[:-1]
    before[new] = _BEGIN
    return rows, h, before, _pair_hash(before, h)


def _pack(a: np.ndarray) -> bytes:
    """Whole numbers, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
    return len(a).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(b: bytes, dtype) -> np.ndarray:
    n, width = int.from_bytes(b[:8], "little"), np.dtype(dtype).itemsize
    if n == 0:
        return np.zeros(0, dtype)
    planes = pa.decompress(b[8:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(width, n).T.copy().view(dtype).ravel()


def _to_blocks(batches):
    """(doc_id, text) -> blocks of a task: ids, words per text, the distinct
    words' hashes and each word's number among them."""
    task, nth, held, size = TaskContext.get().partitionId(), 0, [], 0

    def block():
        ids, lengths, words = zip(*held)
        ids, lengths = pa.concat_arrays(ids), np.concatenate(lengths)
        words, tokens = np.unique(np.concatenate(words), return_inverse=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([(task << 32) + nth]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
             pa.array([len(tokens)]), pa.array([_pack(lengths.astype(np.int64))]), pa.array([_pack(words)]),
             pa.array([_pack(tokens.astype(np.int32))])], ["block", "doc_ids", "n", "lengths", "words", "tokens"])

    for b in batches:
        for lo, hi, buf, offs in X.text_slices(b.column("text")):
            rows, word, _, _ = word_classes(buf, offs)
            held.append((b.column("doc_id").slice(lo, hi - lo), np.bincount(rows, minlength=hi - lo), word))
            size += len(buf) + 64 * (hi - lo)
            if size >= BLOCK_BYTES:
                yield block()
                nth, held, size = nth + 1, [], 0
    if held:
        yield block()


def _grams(words: np.ndarray, lengths: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, ...]:
    """(number of the word before, number of the pair) per word of a block, and
    the block's keys: its words and pairs. The mark's number is the last."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = len(words)
    names, base = np.append(words, _BEGIN), len(words) + 1
    code, pair = np.unique(before.astype(np.int64) * base + tokens, return_inverse=True)
    keys = np.concatenate([words, _pair_hash(names[code // base], names[code % base])])
    return before, pair, keys


def _read_block(table, r: int) -> tuple[np.ndarray, ...]:
    """(words, lengths, tokens) of one row."""
    get = lambda c, t: _unpack(table.column(c)[r].as_py(), t)
    return get("words", _U), get("lengths", np.int64), get("tokens", np.int32)


def _inside(marks, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[marks or []] = True
    return out


def _requests(buckets: int):
    """Blocks with their target texts -> per bucket the block's keys (ascending,
    as differences), with their counts in all texts and in the target's, and
    the words' counts at the ends of texts."""
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                words, lengths, tokens = _read_block(b, r)
                before, pair, keys = _grams(words, lengths, tokens)
                if not len(keys):
                    continue
                member = np.repeat(_inside(b.column("marks")[r].as_py(), len(lengths)), lengths)
                base, size = len(words), len(keys)
                at = np.concatenate([tokens, pair + base])
                ends = np.cumsum(lengths)[lengths > 0] - 1
                order = np.argsort(keys, kind="stable")
                n, n_target, last, last_target = (np.bincount(x, minlength=size)[order] for x in (
                    at, at[np.tile(member, 2)], tokens[ends], tokens[ends[member[ends]]]))
                keys, is_word = keys[order], order < base
                bucket = ((keys >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
                new = np.flatnonzero(np.diff(bucket, prepend=-1))
                rows = []
                for lo, hi in zip(new, [*new[1:], size]):
                    e = slice(lo, hi)
                    rows.append((int(bucket[lo]), _pack(np.diff(keys[e], prepend=_U(0))), _pack(n[e]),
                                 _pack(n_target[e]), _pack(last[e][is_word[e]]), _pack(last_target[e][is_word[e]]),
                                 _pack(np.packbits(is_word[e]))))
                cols = [pa.array([b.column("block")[r].as_py()] * len(rows), pa.int64()), *map(pa.array, zip(*rows))]
                yield pa.RecordBatch.from_arrays(cols, ["block", "bucket", "keys", *_COUNTS, "is_word"])
    return run


_COUNTS = ["n", "n_target", "last", "last_target"]
_OWN = ["vocabulary", "words", "target_words", "texts", "target_texts"]
_ANSWER = "block bigint, bucket bigint, n binary, n_target binary, last binary, last_target binary"
_REQUEST = "block bigint, bucket bigint, keys binary, n binary, n_target binary, last binary, last_target binary, is_word binary"
_TOTAL = _ANSWER + "".join(f", {c} bigint" for c in _OWN)


def _totals(table: pa.Table) -> pa.Table:
    """One bucket's requests -> the totals of each block's keys, and a row of
    the bucket's own (no block): distinct words, words and texts with words of
    all documents and of the target."""
    get = lambda c, t: [_unpack(x.as_py(), t) for x in table.column(c)]
    keys = [np.cumsum(k, dtype=_U) for k in get("keys", _U)]
    words = [np.unpackbits(w, count=len(k)).astype(bool) for w, k in zip(get("is_word", np.uint8), keys)]
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    is_word = np.concatenate(words)
    cuts = np.cumsum([len(k) for k in keys])[:-1], np.cumsum([w.sum() for w in words])[:-1]
    vocabulary = len(np.unique(which[is_word]))
    answers, own = {}, [vocabulary]
    for name in _COUNTS:
        of_words = name.startswith("last")
        counts, at = np.concatenate(get(name, np.int64)), which[is_word] if of_words else which
        # sums of whole numbers under 2**53 are exact
        total = np.bincount(at, weights=counts, minlength=len(distinct)).astype(np.int64)
        answers[name] = pa.array([*map(_pack, np.split(total[at], cuts[of_words])), None], pa.binary())
        own.append(int((counts if of_words else counts[is_word]).sum()))
    blocks = table.column("block").to_pylist()
    return pa.table({
        "block": pa.array([*blocks, None], pa.int64()),
        "bucket": pa.array([table.column("bucket")[0].as_py()] * (len(blocks) + 1), pa.int64()), **answers,
        **{c: pa.array([*[None] * len(blocks), v], pa.int64()) for c, v in zip(_OWN, own)}})


def _own(rows: np.ndarray, numbers: np.ndarray, size: int) -> np.ndarray:
    """Per word, how often its number (of ``size``) is in its own text."""
    _, which, n = np.unique(rows * size + numbers, return_inverse=True, return_counts=True)
    return n[which]


def losses(word, history, pair, n, vocabulary: int) -> np.ndarray:
    """Loss (nats) of every word from the counts of the word, the history and
    the pair, and the number of words, of the texts it is scored by."""
    single = (word + 1.0) / (n + vocabulary)
    return -np.log((pair + PRIOR * single) / (history + PRIOR))


def _score_block(vocabulary: int, known: dict, id_type: pa.DataType):
    """A block and the totals of its keys -> (doc_id, n_words, losses)."""
    def run(block: pa.Table, totals: pa.Table) -> pa.Table:
        ids = block.column("doc_ids").combine_chunks().flatten()
        words, lengths, tokens = _read_block(block, 0)
        before, pair, keys = _grams(words, lengths, tokens)
        answers = totals.sort_by("bucket")
        marks = answers.column("marks").drop_null()
        inside = _inside(marks[0].as_py() if len(marks) else None, len(lengths))
        order = np.argsort(keys, kind="stable")
        rows, base = np.repeat(np.arange(len(lengths)), lengths), len(words)
        own = (_own(rows, tokens, base + 1), _own(rows, before, base + 1), _own(rows, pair, len(keys)), lengths[rows])
        mean = []
        every = np.ones(len(lengths), bool)

        def totals_of(name: str, at: np.ndarray, size: int) -> np.ndarray:
            out = np.zeros(size, np.int64)
            out[at] = np.concatenate([np.zeros(0, np.int64), *(
                _unpack(x.as_py(), np.int64) for x in answers.column(name).drop_null())])
            return out

        for part, of, member in (("_target", "target_", inside), ("", "", every)):
            total = totals_of("n" + part, order, len(keys))
            last = totals_of("last" + part, order[order < base], base)
            history = np.append(total[:base] - last, known[of + "texts"])
            # a text's own counts are in the totals of the corpora that it is of
            seen = total[tokens], history[before], total[pair + base], known[of + "words"]
            loss = losses(*[s - o * member[rows] for s, o in zip(seen, own)], vocabulary)
            mean.append(pa.array(np.bincount(rows, weights=loss, minlength=len(lengths)) / np.maximum(lengths, 1),
                                 pa.float64(), mask=lengths == 0))
        return pa.table({"doc_id": ids.cast(id_type), "n_words": pa.array(lengths, pa.int64()),
                         "target_loss": mean[0], "background_loss": mean[1]})
    return run


def score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_words, target_loss, background_loss, score) per row of
    ``docs`` (doc_id, text); ``target`` (doc_id) names the target's documents."""
    spark = docs.sparkSession
    texts = docs.select(col("doc_id"), col("text").cast("string").alias("text"))
    id_type = texts.schema["doc_id"].dataType
    blocks = materialized(texts.mapInArrow(
        _to_blocks, f"block bigint, doc_ids array<{id_type.simpleString()}>, n bigint, lengths binary, words binary, "
                    "tokens binary"), "lm-blocks")
    ids = target.select(col("doc_id")).where("doc_id is not null").distinct()
    # a merge join at every size: the plan does not depend on the tables
    marks = materialized(
        blocks.select("block", F.posexplode("doc_ids").alias("at", "doc_id")).where("doc_id is not null")
        .join(ids.hint("merge"), "doc_id", "left_semi").groupBy("block").agg(F.collect_list("at").alias("marks")),
        "lm-marks")
    n = blocks.agg(F.sum("n")).first()[0] or 0
    buckets = max(2 * spark.sparkContext.defaultParallelism, -(-n // BUCKET_KEYS))
    requests = blocks.join(marks.hint("merge"), "block", "left").select("block", "lengths", "words", "tokens", "marks") \
        .mapInArrow(_requests(buckets), _REQUEST)
    totals = materialized(requests.groupBy("bucket").applyInArrow(_totals, _TOTAL), "lm-totals")
    known = totals.where("block is null").agg(*[F.sum(c).alias(c) for c in _OWN]).first()
    known = {c: int(known[c] or 0) for c in _OWN}
    answers = totals.where("block is not null").select("block", "bucket", *_COUNTS).unionByName(
        marks.withColumn("bucket", F.lit(-1).cast("bigint")), allowMissingColumns=True)
    run = _score_block(max(known["vocabulary"], 1 << VOCAB_BITS), known, _arrow_type(id_type))
    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        run, f"doc_id {id_type.simpleString()}, n_words bigint, target_loss double, background_loss double")
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def _arrow_type(spark_type) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(spark_type)
