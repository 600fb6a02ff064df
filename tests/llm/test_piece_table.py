import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cases import SF, awkward, awkward_rows, nothing
from filelens.llm import piece_table as P, registry


@pytest.fixture(scope="module")
def sp():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=P.default_model())


def strings(n):
    rng = random.Random(5)
    alphabet = ["a", "B", "the", "▁", " ", "  ", "\n", "\t", "\x00", "é", "中文", "①", "　", "1234", ".", "<s>", "😀", "ﬁ"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(n)]


def test_ids_and_texts_of_the_library(sp, monkeypatch):
    texts = ["", " ", "  ", "a ", " a", "a  b ", "▁", "a▁b", *strings(3000)]
    monkeypatch.setattr(P, "SLICE_CHARS", 200)  # long texts go in portions
    table = P.ChunkTable(P.default_model(), limit=50)
    texts += [" ".join(strings(60)), "x" * 500, " " * 450 + "y", "ab " * 150]
    got = []
    for first, ids, count in table.encode(texts):
        assert first == len(got)
        got += np.split(ids, np.cumsum(count)[:-1])
    assert [g.tolist() for g in got] == [sp.encode(t) for t in texts]
    for g in got:
        assert table.decode(g) == table.decode(g, size=5) == sp.decode(g.tolist())


def test_portions_have_the_chunks_of_the_text():
    for t in strings(2000):
        if t:
            assert [c for p in P.portions(t, 3) for c in P.chunks(p)] == P.chunks(t)


def test_a_chunk_is_segmented_once():
    table = P.ChunkTable(P.default_model())
    for _ in range(3):
        list(table.encode(["one two one", "two three  three", ""]))
    assert table.segmented == 4  # one, two, three and three after another mark


def test_a_model_whose_pieces_cross_marks_goes_whole(sp):
    table = P.ChunkTable(P.default_model())
    table.by_chunk = False
    assert [ids.tolist() for _, ids, _ in table.encode(["one two one", " x"])] == [sp.encode("one two one"), sp.encode(" x")]
    assert table.segmented == 0


def test_awkward_and_empty_tables(spark, sp):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.ids, r.text) for r in P.decode(P.encode(awkward(spark))).collect())
    want = sorted((r[0] is None, r[0] or 0, sp.encode(r[1] or ""), sp.decode(sp.encode(r[1] or ""))) for r in awkward_rows())
    assert got == want
    assert P.decode(P.encode(nothing(spark))).count() == 0
    assert P.decode(spark.createDataFrame([(1, None)], "doc_id int, ids array<int>")).collect()[0].text == ""


def test_query_on_the_whole_table(spark, sp):
    import hashlib

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in
           registry.op11_sentencepiece(spark, SF).collect()}
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = sp.encode(r.text or "")
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
    assert got == want
    assert dict(registry.op11_sentencepiece(spark, SF).dtypes)["n_tokens"] == "bigint"
