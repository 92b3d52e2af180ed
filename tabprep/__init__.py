"""tabprep: table preparation, profiling and model selection on Spark DataFrames.

Every row operation is a DataFrame expression, aggregate, join or window that
Catalyst plans; only small aggregates (one value per column, one row per class,
one row per learner) ever reach the driver.
"""

from tabprep.config import Settings, DEFAULT_SETTINGS

__all__ = ["Settings", "DEFAULT_SETTINGS"]
__version__ = "0.1.0"
