"""flawscope: failure analytics on wide, sparse tables, written as PySpark DataFrame jobs.

Layout
------
sources/    table specs, CSV/Parquet reading and writing, model storage, test-table views
functions/  Column -> Column helpers (no data movement)
operators/  DataFrame -> DataFrame operators: cleaning, joins, statistics, sampling,
            features, clustering, classification, metrics
plans/      composed flows (clustering flow, classification flow, two-stage flow)
streaming/  scoring of newly arriving rows with stored models (Structured Streaming)
"""

from flawscope.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
