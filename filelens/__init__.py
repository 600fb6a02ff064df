"""filelens: a Spark-native semantic index and search library over file tables.

Inventory files, extract text, encode and embed it, keep a versioned vector
index current by upserting only what changed, and answer batches of queries
(exact cosine, BM25, hybrid, chunk-level and approximate candidate search).
Everything heavy is a DataFrame plan; Python runs only inside Arrow batches.
"""

from filelens.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
