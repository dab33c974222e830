"""tabforge: tabular profiling, preparation, model training and scoring on Spark.

Every operator takes and returns Spark DataFrames. Aggregates run as single
distributed passes; only small parameter tables (bounds, category lists,
leaderboards) ever reach the driver.
"""

from tabforge.session import get_session, checkpoint_dir, cut_lineage

__all__ = ["get_session", "checkpoint_dir", "cut_lineage"]
__version__ = "0.1.0"
