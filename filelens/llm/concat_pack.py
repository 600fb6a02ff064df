"""Packing by concatenate and cut.

All documents' token ids form one stream that is cut into windows of
``seq_len``. Two passes of prefix sums place every document without moving
any text: the tokenising tasks number their own tokens and write the ids
once; the totals of the tasks (one row each) then give every task its global
offset, and a second map cuts each document at the window borders. Each
output row is a boundary record: a piece of a document in one window. Only
the last window is short.

Defined cases: a null or empty text is the end mark alone; repeated rows are
packed once per row; a null id is carried; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filelens.operators.common import materialized

from . import textops as X
from .common import col

SEQ_LEN = 2048
END_ID = 1
# Known pre-tokens a worker remembers before it starts afresh.
CACHE_PIECES = 2_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# Fixed value: the split of the byte-level BPE
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Classes of code points in that split: letter, number, other, space.
_L, _N, _O, _S = range(4)
_classes: np.ndarray | None = None


def _class_table() -> np.ndarray:
    global _classes
    if _classes is None:
        import regex

        points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.uint32)
        every = points.tobytes().decode("utf-32-le")
        table = np.full(0x110000, _O, np.uint8)
        for c, pattern in ((_L, r"\p{L}+"), (_N, r"\p{N}+"), (_S, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, every):
                table[points[m.start():m.end()]] = c
        _classes = table
    return _classes


def piece_starts(cp: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """First positions of the byte-level BPE's pre-tokens in concatenated
    texts: runs of letters, numbers or other signs with one space before
    them, white-space runs, and the English contractions."""
    n = len(cp)
    cls = _class_table()[cp]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start = edge[:n].copy()
    start[1:] |= cls[1:] != cls[:-1]
    run = start.copy()
    # a white-space run before a sign: its last character stands alone, and a
    # plain space joins what follows
    follows = np.flatnonzero(run[1:] & ~edge[1:n] & (cls[:-1] == _S)) + 1
    start[follows - 1] = True
    start[follows] = cp[follows - 1] != 0x20
    # 's 't 'm 'd 're 've 'll where no other sign touches the apostrophe
    a = np.flatnonzero((cp == 0x27) & start & run)
    a = a[a + 1 < n]
    a = a[run[a + 1] & ~edge[a + 1] & (cls[a + 1] == _L)]
    c1 = cp[a + 1]
    c2 = np.where((a + 2 < n) & ~edge[np.minimum(a + 2, n)], cp[np.minimum(a + 2, n - 1)], 0)
    one = np.isin(c1, [ord(c) for c in "stmd"])
    two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) \
        | ((c1 == ord("l")) & (c2 == ord("l")))
    for hit, width in ((one, 2), (two, 3)):
        p = a[hit]
        start[p + 1] = False
        q = p + width
        q = q[q < n]
        # what is left of the letter run; other runs start by themselves
        start[q[cls[q] == _L]] = True
    return np.flatnonzero(start)


def _byte_alphabet() -> dict[str, int]:
    """The byte-level BPE's spelling: printable Latin-1 signs stand for their
    own byte, the other bytes for U+0100 onwards in order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class PieceEncoder:
    """Token ids of many texts at once: the texts are split into pre-tokens,
    and only pre-tokens not met before are encoded. A tokenizer file of
    another kind than plain byte-level BPE goes text by text."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        conf = json.loads(self.tok.to_str())
        pre, model = conf.get("pre_tokenizer") or {}, conf["model"]
        self.special = [t["content"] for t in conf.get("added_tokens") or []]
        self.dtype = np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32
        self.by_piece = conf.get("normalizer") is None and pre.get("type") == "ByteLevel" \
            and not pre.get("add_prefix_space") and pre.get("use_regex", True) and model["type"] == "BPE"
        if self.by_piece:
            spelt = _byte_alphabet()
            ranks = {bytes(spelt[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
            made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
            # merges in the order of their ids are what ranks mean
            self.by_piece = made == sorted(made)
            self.bpe = tiktoken.Encoding("pieces", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.id_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
            self.id_bytes[list(ranks.values())] = [len(t) for t in ranks]
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.len = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool = np.zeros(0, self.dtype)

    def _learn(self, keys: np.ndarray, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encodes the pieces cp[start:end] and remembers them by key."""
        size = ends - starts
        # pieces of a space and another sign stay pieces when joined
        joins = (cp[starts] == 0x20) & (size > 1)
        joins &= _class_table()[cp[np.minimum(starts + 1, len(cp) - 1)]] != _S
        lens = np.zeros(len(keys), np.int64)
        parts = []
        j = np.flatnonzero(joins)
        if len(j):
            chars = cp[np.repeat(starts[j] - (np.cumsum(size[j]) - size[j]), size[j]) + np.arange(size[j].sum())]
            ids = np.array(self.bpe.encode_ordinary(chars.tobytes().decode("utf-32-le")), np.int64)
            width = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
            piece_end = np.cumsum(width)[np.cumsum(size[j]) - 1]
            last = np.searchsorted(np.cumsum(self.id_bytes[ids]), piece_end)
            lens[j] = np.diff(last, prepend=-1)
            parts.append(ids.astype(self.dtype))
        alone = np.flatnonzero(~joins)
        for k in alone.tolist():
            ids = self.bpe.encode_ordinary(cp[starts[k]:ends[k]].tobytes().decode("utf-32-le"))
            lens[k] = len(ids)
            parts.append(np.array(ids, self.dtype))
        order = np.concatenate([j, alone])
        at = np.zeros(len(keys), np.int64)
        at[order] = len(self.pool) + np.cumsum(lens[order]) - lens[order]
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.at, self.len = np.insert(self.at, where, at), np.insert(self.len, where, lens)
        self.pool = np.concatenate([self.pool, *parts])

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts and the number of ids of each."""
        size = np.array([len(t) for t in texts], np.int64)
        offs = np.concatenate([[0], np.cumsum(size)])
        cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        if not len(cp):
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        starts = piece_starts(cp, offs)
        ends = np.append(starts[1:], len(cp))
        keys, first, which = np.unique(X.span_hashes(cp, starts, ends, X.code_point_values),
                                       return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE_PIECES:
            self._clear()
        found = np.searchsorted(self.keys, keys)
        miss = np.flatnonzero((found == len(self.keys)) | (self.keys[np.minimum(found, len(self.keys) - 1)] != keys)
                              if len(self.keys) else np.ones(len(keys), bool))
        if len(miss):
            self._learn(keys[miss], cp, starts[first[miss]], ends[first[miss]])
            found = np.searchsorted(self.keys, keys)
        lens = self.len[found][which].astype(np.int64)
        before = np.cumsum(lens) - lens
        ids = self.pool[np.repeat(self.at[found][which] - before, lens) + np.arange(int(lens.sum()))]
        sums = np.concatenate([[0], np.cumsum(lens)])
        row = np.searchsorted(starts, offs)  # every non-empty text starts a piece
        return ids, np.diff(sums[row])

    def encode(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, ids per row) of consecutive groups of texts."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= X.SLICE_BYTES):
                if not self.by_piece or any(s in texts[j] for s in self.special) or len(texts[j]) > 2 * X.SLICE_BYTES:
                    break
                size += len(texts[j])
                j += 1
            if j > i:
                yield i, *self._plain(texts[i:j])
                i = j
            else:
                if not self.by_piece or any(s in texts[i] for s in self.special):
                    ids = np.array(self.tok.encode(texts[i], add_special_tokens=False).ids, self.dtype)
                else:
                    ids = np.concatenate([self._plain([p])[0] for p in _portions(texts[i])])
                yield i, ids, np.array([len(ids)], np.int64)
                i += 1


_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def _portions(text: str) -> Iterator[str]:
    """A long text in parts that end where a pre-token surely ends."""
    at = 0
    while at < len(text):
        m = _SAFE_CUT.search(text, at + X.SLICE_BYTES)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


_IDS = "doc_id {id}, ids binary, n bigint, task int, pos bigint"
_encoders: dict[str, PieceEncoder] = {}


def _tokenise(path: str | None, end_id: int, id_type: pa.DataType):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        p = path or default_tokenizer()
        if p not in _encoders:
            _encoders[p] = PieceEncoder(p)
        enc, task, pos = _encoders[p], TaskContext.get().partitionId(), 0
        for b in batches:
            texts = b.column("text").fill_null("").to_pylist()
            for first, ids, counts in enc.encode(texts):
                ends = np.cumsum(counts)
                flat = np.insert(ids, ends, end_id).astype(enc.dtype)
                n = counts + 1
                offs = np.concatenate([[0], np.cumsum(n)])
                body = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(n), [None, pa.py_buffer((offs * flat.itemsize).astype(np.int64)),
                                                pa.py_buffer(flat)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(first, len(n)).cast(id_type), body, pa.array(n, pa.int64()),
                     pa.array(np.full(len(n), task), pa.int32()), pa.array(pos + offs[:-1], pa.int64())],
                    ["doc_id", "ids", "n", "task", "pos"])
                pos += int(offs[-1])
    return run


def token_table(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids, n, start): ids with the end mark as packed integers (two
    bytes each if the vocabulary allows), and ``start``, the document's place
    in the stream of all ids. Written once."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(col("doc_id"), col("text"))
    kind = rows.schema["doc_id"].dataType
    done = materialized(rows.mapInArrow(_tokenise(tokenizer, end_id, to_arrow_type(kind)),
                                        _IDS.format(id=kind.simpleString())), "token-ids")
    # first pass: a task's total; second: the totals before it. One row per
    # writing task, whatever the number of documents.
    totals = done.groupBy("task").agg(F.max(F.col("pos") + F.col("n")).alias("total"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("task", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return done.join(F.broadcast(bases), "task").select("doc_id", "ids", "n", (F.col("base") + F.col("pos")).alias("at"))


def _cut(seq_len: int, schema: pa.Schema):
    def run(batches):
        for b in batches:
            docs, n = b.column("doc_id"), b.column("n").to_numpy(False)
            at = b.column("at").to_numpy(False)
            if not len(n):
                continue
            first = at // seq_len
            pieces = (at + n - 1) // seq_len - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            seq = first[row] + k
            lo = np.maximum(seq * seq_len, at[row])
            hi = np.minimum((seq + 1) * seq_len, (at + n)[row])
            start, length = lo - at[row], hi - lo
            crc = np.zeros(len(row), np.int64)
            ids, last = None, -1
            for i, (r, s, m) in enumerate(zip(row.tolist(), start.tolist(), length.tolist())):
                if r != last:
                    packed = b.column("ids")[r].as_buffer()  # two or four bytes an id
                    ids, last = np.frombuffer(packed, f"u{len(packed) // n[r]}").astype("<u4"), r
                crc[i] = zlib.crc32(ids[s:s + m])
            yield pa.RecordBatch.from_arrays(
                [docs.take(pa.array(row)), *map(pa.array, (start, length, crc, n[row], seq, lo - seq * seq_len))],
                schema=schema)
    return run


def pack(docs: DataFrame, seq_len: int = SEQ_LEN, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset) of all documents of ``docs`` (doc_id, text)."""
    from pyspark.sql.pandas.types import to_arrow_type

    tokens = token_table(docs, tokenizer, end_id)
    kind = tokens.schema["doc_id"].dataType
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = pa.schema([("doc_id", to_arrow_type(kind)), *((c, pa.int64()) for c in names)])
    return tokens.mapInArrow(_cut(seq_len, schema), f"doc_id {kind.simpleString()}, "
                             + ", ".join(f"`{c}` bigint" for c in names))
