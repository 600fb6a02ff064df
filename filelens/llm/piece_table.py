"""SentencePiece encoding and decoding by a table of distinct chunks.

A piece of the usual models begins with white-space marks or has none, so no
piece crosses from a word into the mark of the next one. A marked text then
falls into chunks (marks and what follows them), and its segmentation is that
of its chunks. Each worker keeps a table of the chunks met so far: a slice of
texts is cut into chunks, those not in the table are segmented once by the
library, and the ids are gathered back by position. The table starts afresh
beyond a bound, so memory does not grow with the corpus; no row is shuffled,
and a lost task depends on nothing but its input.

What the method needs is read off the model and the text: pieces with a mark
after another sign, a mark that is no piece, or a text that the model's
normaliser changes send the text to the library whole.

Defined cases: a null or empty text has no ids and decodes to an empty text;
repeated rows are rows of their own; a null id is carried; other columns are
ignored; an empty table gives an empty result. A text is processed whole
however long, in portions that end at a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col

SLICE_CHARS = 1 << 20     # characters cut into chunks at a time
TABLE_CHUNKS = 1 << 20    # chunks, and
TABLE_CHARS = 1 << 25     # characters of them, that a worker's table holds
DECODE_IDS = 1 << 20      # ids decoded at a time
MARK = "▁"
_MARKED = re.compile(" +[^ ]*")
_BREAK = re.compile("(?<=[^ ]) ")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def chunks(text: str) -> list[str]:
    """The chunks of a text that is preceded by a mark, each without its first
    mark; the other marks are spaces."""
    text = text.replace(MARK, " ")
    if text and text[0] != " " and text[-1] != " " and "  " not in text:
        return text.split(" ")
    return [m[1:] for m in _MARKED.findall(" " + text)]


def portions(text: str, size: int = SLICE_CHARS) -> Iterator[str]:
    """Parts whose chunks are the text's; the mark between two parts is the
    one that precedes the second."""
    if MARK in text:
        text = text.replace(MARK, " ")
    at = 0
    while True:
        m = _BREAK.search(text, at + size) if len(text) - at > size else None
        if m is None:
            yield text[at:]
            return
        yield text[at:m.start()]
        at = m.end()


class ChunkTable:
    """Ids of texts by a table of the distinct chunks met so far."""

    def __init__(self, path: str, limit: int = TABLE_CHUNKS):
        from sentencepiece import SentencePieceProcessor

        self.sp = SentencePieceProcessor(model_file=path)
        self.limit = limit
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        self.by_chunk = self.sp.piece_to_id(MARK) != self.sp.unk_id() \
            and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        before = self.sp.encode("a")
        self.lone_mark = self.sp.encode("a ")[len(before):]
        self.segmented = 0
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.chars = self.used = 0
        self.first, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool = np.zeros(4096, np.int32)

    def _room(self, name: str, n: int) -> None:
        old = getattr(self, name)
        if n > len(old):
            setattr(self, name, np.concatenate([old, np.zeros(max(n, 2 * len(old)) - len(old), old.dtype)]))

    def _segment(self, new: list[str]) -> None:
        lists = self.sp.encode(new, num_threads=1)
        for i, c in enumerate(new):
            if not c:
                lists[i] = self.lone_mark
        size = np.array([len(x) for x in lists], np.int64)
        k, total = len(self.at), int(size.sum())
        self._room("first", k + len(new))
        self._room("size", k + len(new))
        self._room("pool", self.used + total)
        self.first[k:k + len(new)] = self.used + np.cumsum(size) - size
        self.size[k:k + len(new)] = size
        self.pool[self.used:self.used + total] = [x for ids in lists for x in ids]
        self.at.update(zip(new, range(k, k + len(new))))
        self.used += total
        self.chars += sum(map(len, new))
        self.segmented += len(new)

    def gather(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive chunks, and the number of ids of each."""
        if len(self.at) > self.limit or self.chars > TABLE_CHARS:
            self._clear()
        new = set(parts).difference(self.at)
        if new:
            self._segment(sorted(new))
        which = np.fromiter(map(self.at.__getitem__, parts), np.int64, len(parts))
        size = self.size[which]
        before = np.cumsum(size) - size
        return self.pool[np.repeat(self.first[which] - before, size) + np.arange(int(size.sum()))], size

    def _plain(self, text: str) -> bool:
        return self.by_chunk and self.sp.normalize(text) == MARK + text.replace(" ", MARK)

    def _whole(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if not self._plain(text):
            return np.array(self.sp.encode(text), np.int32)
        return np.concatenate([self.gather(chunks(p))[0] for p in portions(text)])

    def encode(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, ids, ids per text) of consecutive groups of texts."""
        i = 0
        while i < len(texts):
            j, size, parts, count = i, 0, [], []
            while j < len(texts) and size + len(texts[j]) <= SLICE_CHARS and (not texts[j] or self._plain(texts[j])):
                size += len(texts[j])
                mine = chunks(texts[j]) if texts[j] else []
                parts += mine
                count.append(len(mine))
                j += 1
            if j > i:
                ids, n = self.gather(parts)
                ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(count)]
                yield i, ids, np.diff(ends, prepend=0)
                i = j
            else:
                ids = self._whole(texts[i])
                yield i, ids, np.array([len(ids)], np.int64)
                i += 1

    def decode(self, ids: np.ndarray, size: int = DECODE_IDS) -> str:
        """The library's decoded text; many ids go in portions that begin with
        a piece that has a mark."""
        if len(ids) <= size or not self.by_chunk:
            return self.sp.decode(ids.tolist())
        anchor = self.sp.encode("a")
        skip, out, at = len(self.sp.decode(anchor)), [], 0
        while at < len(ids):
            end = min(at + size, len(ids))
            while end < len(ids) and not self.sp.id_to_piece(int(ids[end])).startswith(MARK):
                end += 1
            part = ids[at:end].tolist()
            out.append(self.sp.decode(anchor + part)[skip:] if at else self.sp.decode(part))
            at = end
        return "".join(out)


_tables: dict[str, ChunkTable] = {}


def _table(model: str | None) -> ChunkTable:
    path = model or default_model()
    if path not in _tables:
        _tables[path] = ChunkTable(path)
    return _tables[path]


def _encode(model: str | None, id_type: pa.DataType):
    def run(batches):
        for b in batches:
            texts = b.column("text").fill_null("").to_pylist()
            for first, ids, count in _table(model).encode(texts):
                offs = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(first, len(count)).cast(id_type),
                     pa.ListArray.from_arrays(offs, pa.array(ids, pa.int32()))], ["doc_id", "ids"])
    return run


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text): the ids that the
    sentencepiece library gives for the text, without begin or end ids."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(col("doc_id"), col("text"))
    kind = rows.schema["doc_id"].dataType
    return rows.mapInArrow(_encode(model, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, ids array<int>")


def _decode(model: str | None):
    def run(batches):
        for b in batches:
            lists = b.column("ids")
            flat, offs = lists.values.to_numpy(False), lists.offsets.to_numpy(False)
            known = lists.is_valid().to_numpy(False)
            table, at = _table(model), 0
            while at < len(b):
                texts, chars, end = [], 0, at
                while end < len(b) and chars < SLICE_CHARS:
                    texts.append(table.decode(flat[offs[end]:offs[end + 1]]) if known[end] else "")
                    chars += len(texts[-1])
                    end += 1
                yield pa.RecordBatch.from_arrays(
                    [*b.slice(at, end - at).columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])
                at = end
    return run


def decode(tokens: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, text) of every row of ``tokens`` (doc_id, ids): the text
    that the library decodes the ids to (null ids: an empty text)."""
    rows = tokens.select(col("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_decode(model), f"doc_id {kind}, ids array<int>, text string")
