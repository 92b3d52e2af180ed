"""Column expressions for missing tokens, numeric/boolean recognition and repair.

Everything here returns a ``Column``; nothing runs Python per row.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.config import BOOL_FALSE, BOOL_INFER_VALUES, BOOL_TRUE, DATETIME_FORMATS

# A decimal or scientific number, the only strings accepted as numbers.
# (A bare cast would also accept '10d', '10f', 'Infinity'.)
NUMBER_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INTEGER_RE = r"^[+-]?\d+$"
BOOL_LITERAL_VALUES = ("true", "false")

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)


def qcol(name: str) -> Column:
    """Column by exact name, safe for dots, spaces and backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric in the sense of the reference: numbers, not booleans."""
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]


def na_to_null(c: Column, tokens: Iterable[str]) -> Column:
    """Exact, case-sensitive, untrimmed token match → null."""
    return F.when(c.isin(list(tokens)), F.lit(None).cast("string")).otherwise(c)


def nan_to_null(c: Column) -> Column:
    """Spark keeps NaN apart from null; the reproduced semantics treat NaN as missing."""
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def normalize_missing(df: DataFrame) -> DataFrame:
    """NaN → null on float columns, decimals → double. One projection."""
    out = []
    for f in df.schema.fields:
        c = qcol(f.name)
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
            out.append(nan_to_null(c).alias(f.name))
        elif isinstance(f.dataType, FLOAT_TYPES):
            out.append(nan_to_null(c.cast("double")).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def nan_as_null(df: DataFrame) -> DataFrame:
    """NaN → null on float columns, types kept; frames without float columns are returned as they are."""
    if not any(isinstance(f.dataType, FLOAT_TYPES) for f in df.schema.fields):
        return df
    return df.select(*[F.when(~F.isnan(qcol(f.name)), qcol(f.name)).alias(f.name, metadata=f.metadata)
                       if isinstance(f.dataType, FLOAT_TYPES) else qcol(f.name) for f in df.schema.fields])


def missing_is_null(fn):
    """Decorator of operators on a table: they see NaN as missing."""
    @functools.wraps(fn)
    def run(df, *args, **kwargs):
        return fn(nan_as_null(df), *args, **kwargs)
    return run


#: What ``\s`` means in a pattern, and the signs and letters that repair drops.
WHITE_SPACE, SIGNS = " \t\n\x0b\f\r", ",$%€£¥"
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Before one of these, or a line break, at the very end ``$`` matches too.
_TERMINATORS = ("\u0085", "\u2028", "\u2029")
_BREAKS_RE = r"[\n\r\x{85}\x{2028}\x{2029}]"


def _odd_end(c: Column) -> Column:
    return F.substring(c, -1, 1).isin(*_TERMINATORS)


def strip_ws(c: Column) -> Column:
    """Without white space at both ends; the pattern is needed only where a value ends with a terminator beyond ASCII."""
    return F.when(_odd_end(c), F.regexp_replace(c, r"^\s+|\s+$", "")).otherwise(F.trim(c, F.lit(WHITE_SPACE)))


def _without_cleaning(c: Column, number: Column, none: Column):
    """Plain numbers and values without a digit need no cleaning."""
    return F.when(c.rlike(NUMBER_RE), number).when(~c.rlike("[0-9]"), none)


def looks_numeric(c: Column, units_ok: bool = False) -> Column:
    """V1: drop , $ % € £ ¥ and whitespace, then the rest must be a number; ``units_ok``: letters at the end go first, with
    the white space after them."""
    def rest(x: Column) -> Column:
        return F.translate(x, SIGNS + WHITE_SPACE, "").rlike(NUMBER_RE)
    first = _without_cleaning(c, F.lit(True), F.lit(False))
    if units_ok:
        first = first.when(_odd_end(c), rest(F.regexp_replace(c, r"[a-zA-Z]+\s*$", "")))
        c = F.rtrim(F.rtrim(c, F.lit(WHITE_SPACE)), F.lit(LETTERS))
    return first.otherwise(rest(c))


def clean_numeric_string(c: Column) -> Column:
    """V3: trim, drop symbols, drop trailing letters (units), drop spaces, parse or null."""
    def parsed(v: Column) -> Column:
        return F.when(v.rlike(NUMBER_RE), v.try_cast("double"))
    bare = F.rtrim(F.translate(F.trim(c, F.lit(WHITE_SPACE)), SIGNS, ""), F.lit(LETTERS))
    # values with a line break go by patterns, whose $ also matches before one
    slow = F.regexp_replace(F.translate(F.regexp_replace(c, r"^\s+|\s+$", ""), SIGNS, ""), r"[a-zA-Z]+$", "")
    return (_without_cleaning(c, c.try_cast("double"), F.lit(None).cast("double"))
            .when(c.rlike(_BREAKS_RE), parsed(F.replace(slow, F.lit(" "), F.lit(""))))
            .otherwise(parsed(F.replace(bare, F.lit(" "), F.lit("")))))


def parses_as_number(c: Column) -> Column:
    """Whole (trimmed) value is a number, as a strict float parse would accept."""
    return strip_ws(c).rlike(NUMBER_RE)


def parses_as_integer(c: Column) -> Column:
    return strip_ws(c).rlike(INTEGER_RE)


def parses_as_bool_literal(c: Column) -> Column:
    return F.lower(strip_ws(c)).isin(list(BOOL_LITERAL_VALUES))


#: What a part of a timestamp pattern can read at all: years of four digits or more, the rest of two.
_PARTS = (("yyyy", "[+-]?[0-9]{4,19}"), ("MM", "[0-9]{2}"), ("dd", "[0-9]{2}"), ("HH", "[0-9]{2}"), ("mm", "[0-9]{2}"), ("ss", "[0-9]{2}"), ("'T'", "[Tt]"), (".", "[.]"))


def _shape(fmt: str) -> str:
    out = fmt.replace(".", "\0")
    for part, pattern in _PARTS:
        out = out.replace("\0" if part == "." else part, pattern)
    return f"^{out}$"


def parses_as_datetime(c: Column) -> Column:
    """Some timestamp pattern of the fixed list reads the value. A value is handed only to the pattern of its shape: each
    attempt that fails costs an exception."""
    v = strip_ws(c)
    read = F.coalesce(*[F.when(v.rlike(_shape(fmt)), F.try_to_timestamp(v, F.lit(fmt))) for fmt in DATETIME_FORMATS])
    return F.coalesce(v.rlike("^[+-]?[0-9]+[-/.][0-9]{2}[-/.]"), F.lit(False)) & read.isNotNull()


def in_bool_infer_set(c: Column) -> Column:
    return F.lower(strip_ws(c)).isin(list(BOOL_INFER_VALUES))


def in_bool_repair_set(c: Column) -> Column:
    return F.lower(strip_ws(c)).isin(list(BOOL_TRUE + BOOL_FALSE))


def to_bool_int(c: Column) -> Column:
    """V5: true-ish → 1, false-ish → 0, anything else → null."""
    v = F.lower(strip_ws(c))
    return F.when(v.isin(list(BOOL_TRUE)), F.lit(1)).when(v.isin(list(BOOL_FALSE)), F.lit(0))


def safe_div(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(None)).otherwise(num / den)
