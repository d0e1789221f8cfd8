"""skeinlog: event-log analytics on Spark DataFrames.

Catalog and hash-chained event tables go in, DataFrames come out.  The
subpackages hold the relational operators (``operators``), readers and
writers (``sources``), column functions (``functions``), named queries and
their SQL twins (``plans``) and Structured Streaming operators
(``streaming``).
"""

from skeinlog.session import build_session, checkpointed, load_table

__all__ = ["build_session", "checkpointed", "load_table"]
