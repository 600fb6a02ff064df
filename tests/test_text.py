import pytest
from pyspark.sql import functions as F

from filelens.functions import text as X
from filelens.operators import chunks, embed
from filelens.operators.common import global_rank


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("n_words,n_windows,last_real", [
    (0, 1, 2), (1, 1, 3), (253, 1, 255), (254, 1, 256), (255, 2, 3), (508, 2, 256), (509, 3, 3),
])
def test_encode_windows_lengths(spark, n_words, n_windows, last_real):
    docs = _docs(spark, [" ".join(f"w{i % 50}" for i in range(n_words))])
    vocab = embed.vocab_build(docs)
    enc = embed.encode_windows(docs, vocab).orderBy("window").collect()
    assert len(enc) == n_windows
    for r in enc:
        assert len(r.input_ids) == 256 and len(r.attention_mask) == 256
        assert r.input_ids[0] == X.CLS_ID
        real = sum(r.attention_mask)
        assert r.input_ids[real - 1] == X.SEP_ID
        assert all(i == X.PAD_ID for i in r.input_ids[real:])
    assert sum(enc[-1].attention_mask) == last_real


def test_vocab_order_and_ids(spark):
    docs = _docs(spark, ["b a a c", "a b", "d"])
    v = {r.tok: (r.cnt, r.token_id) for r in embed.vocab_build(docs).collect()}
    assert v == {"a": (3, 4), "b": (2, 5), "c": (1, 6), "d": (1, 7)}


def test_global_rank_dense(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("x")).repartition(7)
    r = global_rank(df, [F.desc("x")], "r").orderBy("r").collect()
    assert [x.r for x in r] == list(range(1, 5001))
    assert [x.x for x in r] == sorted((x.x for x in r), reverse=True)


def test_fixed_length_and_mask(spark):
    df = spark.createDataFrame([([5, 6, 7],), ([],), (list(range(1, 300)),)], "ids array<bigint>")
    out = df.select(X.fixed_length("ids", 4).alias("f")).collect()
    assert [r.f for r in out] == [[5, 6, 7, 0], [0, 0, 0, 0], [1, 2, 3, 4]]
    m = df.select(X.mask_from_ids(X.fixed_length("ids", 4)).alias("m")).collect()
    assert [r.m for r in m] == [[1, 1, 1, 0], [0, 0, 0, 0], [1, 1, 1, 1]]
    bad = spark.createDataFrame([([1, 2], [1])], "i array<bigint>, m array<bigint>")
    assert bad.select(X.checked_encoding("i", "m", 2).alias("e")).first()["e"] is None


def test_hashed_embed_unit_and_empty(spark):
    docs = _docs(spark, ["the cat sat on the mat", "!!! ...", "Über straße"])
    out = {r.doc_id: r.embedding for r in embed.hashed_embed(docs, dim=16).collect()}
    assert sum(x * x for x in out[0]) == pytest.approx(1.0)
    assert out[1] == [0.0] * 16
    assert sum(x * x for x in out[2]) == pytest.approx(1.0)


def test_hashed_embed_and_terms_match_brute_force(spark):
    """Dense and sparse hashed vectors against a plain Python restatement
    (lower-case, runs of letters/digits, md5 bucket, tf / ||tf||)."""
    import hashlib
    import math
    import re
    texts = ["the cat sat on the mat", "", None, "a b c a b a", "Über straße 42 ÜBER", "x " * 5000]
    docs = _docs(spark, texts)
    dense = {r.doc_id: r.embedding for r in embed.hashed_embed(docs, dim=8).collect()}
    sparse = {}
    for r in embed.hashed_terms(docs, dim=8).collect():
        sparse.setdefault(r.doc_id, [0.0] * 8)[r.bucket] = r.weight
    for i, t in enumerate(texts):
        tf = [0] * 8
        for w in re.findall(r"[^\W_]+", (t or "").lower()):
            tf[int(hashlib.md5(w.encode()).hexdigest()[:7], 16) % 8] += 1
        nrm = math.sqrt(sum(x * x for x in tf))
        want = [x / nrm if nrm else 0.0 for x in tf]
        assert dense[i] == pytest.approx(want, abs=1e-15)
        assert sparse.get(i, [0.0] * 8) == pytest.approx(want, abs=1e-15)


def test_chunks_cover_whole_text(spark):
    texts = ["x" * n for n in (0, 1, 1000, 1001, 1800, 5000)]
    c = chunks.chunk_docs(_docs(spark, texts)).collect()
    for i, t in enumerate(texts):
        mine = sorted((r.start, r.chunk) for r in c if r.doc_id == i)
        covered = set()
        for s, ch in mine:
            covered.update(range(s, s + len(ch)))
            assert ch == t[s:s + 1000]
        assert covered == set(range(len(t)))


def test_chunks_of_long_texts_and_wide_ids(spark):
    # linear in the text, and ids near the end of the long range are fine
    text = "".join(chr(97 + i % 26) for i in range(1_000_000)) + "\U0001f600" * 900
    rows = [(2**63 - 1, text), (-(2**63), None), (7, "x" * 1000), (8, "x" * 1001)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    c = chunks.chunk_docs(df).collect()
    long = sorted((r.start, r.chunk) for r in c if r.doc_id == 2**63 - 1)
    assert all(ch == text[s:s + 1000] for s, ch in long) and len(long) == -(-(len(text) - 200) // 800)
    assert [(r.chunk_no, r.chunk) for r in c if r.doc_id < 0] == [(0, None)]
    assert sorted(len(r.chunk) for r in c if r.doc_id in (7, 8)) == [201, 1000, 1000]


def test_words_unicode(spark):
    df = spark.createDataFrame([("Ça va? L'été 2024, naïve—ok",)], "t string")
    assert df.select(X.words("t").alias("w")).first()["w"] == ["ça", "va", "l", "été", "2024", "naïve", "ok"]


def test_masked_mean_pool_map_equals_shuffle_form(spark, monkeypatch):
    texts = ["the cat sat on the mat", "", None, "cat cat cat", "one two three four five six seven"]
    docs = _docs(spark, texts)
    # token ids 0..6 exist except 4: words hashing to 4 count in the divisor only
    table = spark.createDataFrame([(i, [float(i), float(-i), 0.5]) for i in range(7) if i != 4],
                                  "vec_id long, embedding array<float>")

    def rows(df):
        return sorted((r.doc_id, r.pos, round(r.value, 9)) for r in df.collect())

    mapped = rows(embed.masked_mean_pool(docs, table, 7))
    monkeypatch.setattr(embed, "POOL_TABLE_MAX_BYTES", 0)
    joined = rows(embed.masked_mean_pool(docs, table, 7))
    assert mapped == joined
    assert {d for d, _, _ in mapped} <= {0, 3, 4}
    # a repeated word: the mean of three copies of one token vector is that vector
    t = X.hash_bucket_py("cat", 7)
    if t != 4:
        assert [v for d, _, v in mapped if d == 3] == pytest.approx([float(t), float(-t), 0.5])


def test_encode_windows_map_equals_join_form(spark, monkeypatch):
    texts = ["", None, "a b c", " ".join(f"w{i % 7}" for i in range(254)), " ".join(f"w{i % 9}" for i in range(600)),
             "unknown words here"]
    docs = _docs(spark, texts)
    vocab = embed.vocab_build(_docs(spark, ["a b c w1 w2 w3 w4 w5 w6 w0 w7 w8"]))

    def rows(df):
        return sorted((r.doc_id, r.window, tuple(r.input_ids), tuple(r.attention_mask)) for r in df.collect())

    mapped = rows(embed.encode_windows(docs, vocab))
    monkeypatch.setattr(embed, "BROADCAST_MAX_ROWS", -1)
    joined = rows(embed.encode_windows(docs, vocab))
    assert mapped == joined
    assert [w for d, w, _, _ in mapped if d == 4] == [0, 1, 2]
    assert all(ids[1] == X.UNK_ID for d, _, ids, _ in mapped if d == 5)


def test_windows_of_a_large_vocabulary_by_blocks(spark, monkeypatch):
    from filelens.operators import embed
    docs = spark.createDataFrame([(i % 90, " ".join(f"w{(i * j) % 37}" for j in range(i % 23))) for i in range(100)]
                                 + [(200, None), (201, ""), (202, "unseen w1 unseen")], "doc_id long, text string").repartition(3)
    vocab = embed.vocab_build(docs).where("tok <> 'unseen'")
    want = sorted(map(str, embed.encode_windows(docs, vocab, n=8).collect()))
    monkeypatch.setattr(embed, "BROADCAST_MAX_ROWS", -1)
    monkeypatch.setattr(embed, "ENCODE_TEXTS", 16)
    assert sorted(map(str, embed.encode_windows(docs, vocab, n=8).collect())) == want  # ids that repeat stay texts of their own
    assert embed.encode_windows(docs, vocab.where("false"), n=8).where("exists(input_ids, x -> x > 3)").count() == 0
    plan = embed.encode_windows(docs, vocab, n=8)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "collect_list" not in plan  # no row per word of a text


def test_kernels_take_batches_in_pieces(spark):
    import pyarrow as pa

    from filelens.operators import embed
    b = pa.RecordBatch.from_arrays([pa.array(range(2500))], ["i"])
    pieces = list(embed.slices([b, b.slice(0, 0)]))
    assert [p.num_rows for p in pieces] == [1000, 1000, 500] and pa.Table.from_batches(pieces).column("i").to_pylist() == list(range(2500))


def test_words_in_one_string_are_the_words(spark):
    import numpy as np
    import pyarrow as pa

    texts = [None, "", "  ", "?!", "Straße ÄÖ, x_y 1½ ² Ⅷ", "a\u0301b \U00010400 İ ß\u00a0z\tq\n",
             "٣٤ 漢字カナ-x", "one", " one  two one "] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").orderBy("i")
    rows = df.select(X.words("text").alias("w"), X.word_text("text").alias("t")).collect()
    joined = pa.array([r.t for r in rows])
    for a in range(len(rows)):  # parts of a batch too
        lens, words, codes = X.split_words(joined.slice(a, 11))
        flat = [w for r in rows[a:a + 11] for w in r.w or []]
        assert lens.tolist() == [len(r.w or []) for r in rows[a:a + 11]]
        assert [words[int(c)].as_py() for c in codes] == flat
        assert X.hash_buckets(words, 97).tolist() == [X.hash_bucket_py(w, 97) for w in words.to_pylist()]
    assert X.hash_buckets(pa.array([], pa.string()), 7).dtype == np.int64
