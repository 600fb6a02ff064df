import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from cases import SF, awkward, nothing
from filelens.llm import concat_pack as C


def true_ids(texts):
    tok = Tokenizer.from_file(C.default_tokenizer())
    return [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(pieces, texts):
    """Every id of every document in exactly one piece, windows without gaps."""
    want = sorted(tuple(i) + (1,) for i in true_ids(texts))
    by_seq = {}
    for r in pieces:
        assert 1 <= r.length <= 2048 and r.offset + r.length <= 2048
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_seq.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at = o + n
    full = [sum(n for _, n in s) for s in by_seq.values()]
    assert sum(n < 2048 for n in full) <= 1 and sum(full) == sum(map(len, want))
    return want


def test_query_round_trip(spark):
    from filelens.llm.registry import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pieces = QUERIES["op8_packing"](spark, SF).collect()
    check(pieces, docs.values())
    ids = dict(zip(docs, true_ids(docs.values())))
    got = {}
    for r in pieces:
        part = np.array(ids[r.doc_id] + [1], "<u4")[r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids[r.doc_id]) + 1
        got.setdefault(r.doc_id, []).append((r.start, r.length))
    assert got.keys() == docs.keys()
    for spans in got.values():
        at = 0
        for s, n in sorted(spans):
            assert s == at
            at = s + n


def test_encoder_is_the_tokenizer():
    rng = random.Random(3)
    signs = list("aab's'trevelmdl  \n\t12é,.! 　ñ中\U0001f600\x1c\u0085")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    texts += ["x<|endoftext|>y", "", "don't I'll we've they'd", " 's", "'", "a" * 3000, "  \n\n  "]
    got = []
    for _, ids, counts in C.PieceEncoder(C.default_tokenizer()).encode(texts):
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == true_ids(texts)


def test_long_text_in_portions(monkeypatch):
    monkeypatch.setattr(C.X, "SLICE_BYTES", 500)
    text = " ".join(f"It's w{i}.\n\nnext" for i in range(900))
    (_, ids, _), = C.PieceEncoder(C.default_tokenizer()).encode([text])
    assert ids.tolist() == true_ids([text])[0]


def test_awkward_tables(spark):
    df = awkward(spark)
    check(C.pack(df).collect(), [r.text for r in df.collect()])
    assert C.pack(nothing(spark)).count() == 0
