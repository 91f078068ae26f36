"""Column-level helpers."""

from flawscope.functions.columns import (clip, dot, double_matrix, equals_text, free_name, missing,
                                         nearest, non_null_array, presence, q, squared_distance_arrays)

__all__ = ["clip", "dot", "double_matrix", "equals_text", "free_name", "missing", "nearest",
           "non_null_array", "presence", "q", "squared_distance_arrays"]
