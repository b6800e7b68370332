"""revlens: customer-feedback analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames keyed by ``session_id`` (one
analysis run) and ``user_id``, so one job processes any number of sessions.
"""

from revlens.session import get_spark, checkpoint_dir, cut_lineage

__all__ = ["get_spark", "checkpoint_dir", "cut_lineage"]
