"""kbweave: support knowledge-base building and retrieval as Spark jobs.

Every operator is a plain function over DataFrames (or a ``Column`` builder),
so the same code runs in batch jobs and inside Structured Streaming.
"""

from kbweave.config import Params, get_session

__all__ = ["Params", "get_session"]
