"""Text expressions: word split, hashed buckets, content hash, UTF-8 repair,
fixed-length encodings."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from filelens.schema import MAX_SEQ_LEN

# Word = maximal run of Unicode letters or digits, after lower-casing.
WORD_PATTERN = r"[\p{L}\p{N}]+"
# Vocabulary ids reserved ahead of the corpus words.
PAD_ID, CLS_ID, SEP_ID, UNK_ID = 0, 1, 2, 3
FIRST_WORD_ID = 4


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text) -> Column:
    """array<string> of lower-cased words of the whole text."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD_PATTERN), 0)


def word_text(text) -> Column:
    """The words of :func:`words` in one string with a space between, which
    is cheaper to hand to Python; :func:`split_words` takes it apart."""
    return F.btrim(F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{N}]+", " "))


def split_words(joined: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(words per text, distinct words, place of each word among them) of
    :func:`word_text` in an Arrow batch; a null text has no words."""
    lens, words, codes = coded_words(pc.split_pattern(joined, " "))
    # a text without words is split into an empty one
    none = pc.fill_null(pc.equal(joined, ""), False).to_numpy(zero_copy_only=False)
    if none.any():
        lens[none] = 0
        codes = codes[codes != pc.index(words, "").as_py()]
    return lens, words, codes


def coded_words(ws: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """:func:`split_words` of a column of word lists."""
    lens = pc.fill_null(pc.list_value_length(ws), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    enc = pc.dictionary_encode(pc.list_flatten(ws))
    return lens, enc.dictionary, enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def hash_bucket(token, n_buckets: int) -> Column:
    """Stable bucket of a token: first 7 hex digits of md5, mod n."""
    h = F.conv(F.substring(F.md5(_c(token)), 1, 7), 16, 10).cast("bigint")
    return (h % F.lit(n_buckets)).cast("bigint")


def hash_bucket_py(token: str, n_buckets: int) -> int:
    """The same bucket as :func:`hash_bucket`, for code inside Arrow batches."""
    return int(hashlib.md5(token.encode("utf-8")).hexdigest()[:7], 16) % n_buckets


def hash_buckets(tokens: pa.Array, n_buckets: int) -> np.ndarray:
    """:func:`hash_bucket_py` of each of (distinct) tokens."""
    md5 = hashlib.md5
    heads = b"".join([md5(t).digest()[:4] for t in tokens.cast(pa.binary()).to_numpy(zero_copy_only=False)])
    return (np.frombuffer(heads, dtype=">u4") >> 4).astype(np.int64) % n_buckets


def content_hash(text) -> Column:
    return F.sha2(_c(text), 256)


def repaired_text(content) -> Column:
    """Bytes -> string without failing on invalid UTF-8 (bad bytes become
    U+FFFD). ``decode`` would abort the whole job on one bad byte."""
    return F.make_valid_utf8(_c(content).cast("string"))


def is_valid_utf8(content) -> Column:
    return F.is_valid_utf8(_c(content).cast("string"))


def fixed_length(ids, n: int = MAX_SEQ_LEN) -> Column:
    """Truncate or right-pad an id array to exactly ``n`` with PAD_ID."""
    ids = _c(ids)
    head = F.slice(ids, 1, n)
    pad = F.array_repeat(F.lit(PAD_ID).cast("bigint"), F.greatest(F.lit(n) - F.size(head), F.lit(0)))
    return F.concat(head, pad)


def mask_from_ids(ids) -> Column:
    """Attention mask fallback: pad id -> 0, anything else -> 1."""
    return F.transform(_c(ids), lambda x: F.when(x == PAD_ID, F.lit(0)).otherwise(F.lit(1)).cast("bigint"))


def checked_encoding(ids, mask, n: int = MAX_SEQ_LEN) -> Column:
    """struct(input_ids, attention_mask, token_type_ids) when both arrays have
    exactly ``n`` entries, else NULL (an encoding failure)."""
    ids, mask = _c(ids), _c(mask)
    ok = (F.size(ids) == n) & (F.size(mask) == n)
    enc = F.struct(ids.alias("input_ids"), mask.alias("attention_mask"),
                   F.array_repeat(F.lit(0).cast("bigint"), n).alias("token_type_ids"))
    return F.when(ok, enc)
