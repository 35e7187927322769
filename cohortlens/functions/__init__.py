"""Column-expression helpers (pure JVM expressions, no Python UDFs)."""

from cohortlens.functions.columns import (  # noqa: F401
    cast_all, rename_positional, suffix_columns, project, valid_rows,
    row_sum, mean_abs_distance, minmax_scale,
)
from cohortlens.functions.hashing import hash_key, hash_uniform, hash_order  # noqa: F401
