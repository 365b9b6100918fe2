"""scriptorium: literature analytics expressed as Spark DataFrame plans.

Sub-packages
------------
sources    readers and writers (citation XML, id lists, CSV, text blocks, stores)
functions  column expressions (text cleaning, tokens, dates, rule lookups)
operators  multi-step DataFrame operators (geo, chemistry, topics, vectors, ...)
plans      the registered queries and their stand-in inputs
streaming  Structured Streaming ingest
"""

from scriptorium.session import build_session, checkpoint_dir, read_table

__all__ = ["build_session", "checkpoint_dir", "read_table"]
