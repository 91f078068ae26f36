"""Sources and sinks: CSV/Parquet tables, stored models, test-table views."""

from flawscope.sources.models import (get_or_train, load_classifier, load_kmeans, path_exists,
                                      save_classifier, save_kmeans)
from flawscope.sources.tables import TableSpec, load_table, read_csv, select_roles, table_shape, write_csv

__all__ = ["TableSpec", "get_or_train", "load_classifier", "load_kmeans", "load_table", "path_exists",
           "read_csv", "save_classifier", "save_kmeans", "select_roles", "table_shape", "write_csv"]
