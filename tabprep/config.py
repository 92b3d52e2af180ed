"""Thresholds and fixed token lists.

All numbers default to the behaviour being reproduced; every one is a field of
a frozen dataclass so a caller can override it per run without global state.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values that must equal the reproduced behaviour (kept verbatim).
# ---------------------------------------------------------------------------

# Encodings tried in order when bytes are not valid UTF-8.
ENCODING_ATTEMPTS = ("utf-8", "latin-1", "iso-8859-1", "cp1252", "utf-16", "utf-16-le", "utf-16-be")

# Delimiter candidates, in tie-break order.
DELIMITER_ATTEMPTS = (",", ";", "|", "\t", "^", "~", ":")

# Cell values read as missing (exact, case-sensitive, untrimmed).
MISSING_INDICATORS = (
    "", " ", "  ", "   ",
    "NA", "N/A", "na", "n/a", "N.A.", "n.a.",
    "NaN", "nan", "NAN",
    "null", "NULL", "Null",
    "None", "none", "NONE",
    "NIL", "nil", "Nil",
    "?", "??", "???",
    "--", "—", "___", "_",
    ".", "..", "...",
    "Missing", "MISSING", "missing",
    "Unknown", "UNKNOWN", "unknown",
    "N", "n",
)

# The CSV reader's own default missing markers, applied on top of the list above.
READER_DEFAULT_NA = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# Invisible code points removed from column names.
INVISIBLE_CHARS = ("\u200b", "\u200c", "\u200d", "\ufeff", "\ufffe", "\u00a0", "\u2028", "\u2029")

# Column-name fragments that mark an identifier.
ID_KEYWORDS = ("id", "key", "index", "uuid", "guid")

# Lower-cased values accepted as boolean in type inference.
BOOL_INFER_VALUES = ("true", "false", "1", "0", "yes", "no", "t", "f", "y", "n")

# Boolean repair vocabularies.
BOOL_TRUE = ("true", "1", "yes", "t", "y", "on")
BOOL_FALSE = ("false", "0", "no", "f", "n", "off")

# Currency / grouping symbols removed before a numeric test.
NUMERIC_NOISE_CHARS = ",$%€£¥"

# Timestamp patterns tried when testing whether a string column is a date.
DATETIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd-MM-yyyy",
    "dd.MM.yyyy",
)


@dataclass(frozen=True)
class Settings:
    """Every threshold in force. Defaults reproduce the reference run."""

    max_file_size_mb: float | None = None      # off by default; 500 reproduces the upload cap
    warn_file_size_mb: float = 100.0
    sniff_bytes: int = 1000
    delimiter_sample_lines: int = 10
    max_missing_ratio: float = 0.95
    min_variance: float = 1e-10
    max_cardinality_ratio: float = 0.95
    min_rows: int = 10
    min_samples_per_class: int = 2
    max_categories_ohe: int = 50
    rare_category_threshold: float = 0.01
    outlier_z: float = 5.0
    outlier_iqr: float = 3.0
    eda_outlier_iqr: float = 1.5
    seed: int = 42
    test_size: float = 0.2
    max_training_seconds: float = 300.0
    max_training_rows: int | None = None
    search_method: str = "random"
    search_iterations: int = 20
    search_folds: int = 3
    feature_engineering: bool = True
    high_missing_pct: float = 50.0
    id_min_distinct: int = 100
    high_cardinality_distinct: int = 50
    high_corr: float = 0.9
    leakage_corr: float = 0.99
    regression_min_distinct: int = 20
    balance_ratio: float = 3.0
    feasibility_min_rows: int = 50
    histogram_bins: int = 30
    top_k: int = 10
    missing_tokens: tuple = field(default=MISSING_INDICATORS + tuple(
        t for t in READER_DEFAULT_NA if t not in MISSING_INDICATORS))


DEFAULT_SETTINGS = Settings()
