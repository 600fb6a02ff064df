"""Schemas of the index store and the fixed values of the workload."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the original tool's for identical results.
# ---------------------------------------------------------------------------
ALLOWED_EXTENSIONS = [".txt", ".pdf", ".png", ".jpg", ".jpeg"]
IMAGE_EXTENSIONS = [".png", ".jpg", ".jpeg"]
MODEL_NAME = "all-MiniLM-L6-v2-ONNX"
EMBEDDING_DIM = 384
MAX_SEQ_LEN = 256
DEFAULT_K = 5
DEFAULT_LIST_LIMIT = 200
L2_EPS = 1e-12
# Metadata rows written at each store open (key, value).
METADATA_DEFAULTS = [
    ("model_name", MODEL_NAME),
    ("embedding_dim", str(EMBEDDING_DIM)),
    ("max_seq_len", str(MAX_SEQ_LEN)),
]
# ---------------------------------------------------------------------------

SCHEMA_VERSION = "1"
SCORE_DECIMALS = 6

FILES_SCHEMA = T.StructType([
    T.StructField("file_id", T.LongType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("extension", T.StringType(), True),
    T.StructField("last_modified", T.LongType(), True),
])

VECTORS_SCHEMA = T.StructType([
    T.StructField("file_id", T.LongType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType()), False),
])

# One row per file: the files table and its vector side by side. The store
# keeps them in one Parquet table; ``embedding`` is pruned by every browse
# query because Parquet reads only the selected columns.
INDEX_SCHEMA = T.StructType(FILES_SCHEMA.fields + [
    T.StructField("embedding", T.ArrayType(T.FloatType()), True),
    T.StructField("content_hash", T.StringType(), True),
])

METADATA_SCHEMA = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.StringType(), False),
])

INVENTORY_SCHEMA = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("extension", T.StringType(), True),
    T.StructField("last_modified", T.LongType(), True),
    T.StructField("size_bytes", T.LongType(), True),
])

RESULT_SCHEMA = T.StructType([
    T.StructField("path", T.StringType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("extension", T.StringType(), True),
    T.StructField("score", T.DoubleType(), True),
])
