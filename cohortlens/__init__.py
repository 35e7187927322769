"""cohortlens: cohort analytics on Spark DataFrames.

Every operator takes DataFrames (plus column names) and returns a DataFrame;
the work runs as Spark joins, aggregates, windows and MLlib fits.
"""

from cohortlens.session import get_session, checkpoint_dir, scratch_path  # noqa: F401

__all__ = ["get_session", "checkpoint_dir", "scratch_path"]
