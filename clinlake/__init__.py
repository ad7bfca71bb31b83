"""clinlake: clinical data and analytics as Spark DataFrame jobs.

Every operator is a function from DataFrame(s) to a DataFrame built on the
public PySpark API.  No operator creates a session or collects data it does
not bound by construction (a per-feature statistic, a small rule table).
"""

from clinlake.session import build_session, checkpoint_dir, table, tables

__all__ = ["build_session", "checkpoint_dir", "table", "tables"]
