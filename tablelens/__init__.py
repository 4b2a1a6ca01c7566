"""tablelens — table profiling on Spark DataFrames.

Given any DataFrame, ``profile(df)`` returns lazy report DataFrames (table
totals, per-column facts, typed sections, warnings) computed by a small,
fixed number of distributed passes using built-in Spark expressions.
"""

__version__ = "0.1.0"

from .plans.report import Profile, dtype_classes, light_profile, profile, profile_many  # noqa: E402
from .sources.readers import load  # noqa: E402
from .sinks.report_io import read_column_report, read_flat_csv, save_profile  # noqa: E402

__all__ = [
    "Profile", "profile", "profile_many", "light_profile", "dtype_classes", "load",
    "save_profile", "read_column_report", "read_flat_csv", "__version__",
]
