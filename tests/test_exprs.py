"""Expressions that spare patterns give what the patterns give, on odd values too."""
import itertools
import time

from pyspark.sql import functions as F

from tabprep.config import DATETIME_FORMATS
from tabprep.functions import exprs as E


def _values():
    ends = ["", " ", "\n", "\r\n", "\t ", "\u0085", " \u0085", " ", "  ", "\x0b", " ", "kg", "kg ", "k g", "kg\n", "kg\u0085", " kg\n$", "kg  "]
    bodies = ["", "1", "-1.5e3", "$1,200", "€ 3", "abc", "1 2", "yes", "12e5x", "1994-01-02", "1994-13-02", "1994-1-2", "+12345-01-02", "-1994-01-02", "01/02/1994", "31/12/1994", "01/02/+19945",
              "31-12-1994", "31.12.1994", "1994/12/31", "1994-01-02 03:04:05", "1994-01-02T03:04:05", "1994-01-02t03:04:05", "1994-01-02T25:04:05", "1994-01-02 03:04", "19940102", "-19945-01-01", "日本", "١٢"]
    return [(a + b + c,) for a, b, c in itertools.product(["", " ", "\u0085", "\n"], bodies, ends)] + [(None,)]


def _plain():
    c = F.col("c")
    strip = F.regexp_replace(c, r"^\s+|\s+$", "")
    v = F.regexp_replace(F.regexp_replace(F.regexp_replace(strip, r"[,$%€£¥]", ""), r"[a-zA-Z]+$", ""), " ", "")

    def looks(x):
        return F.regexp_replace(x, r"[,$%€£¥\s]", "").rlike(E.NUMBER_RE)
    return {"strip": (strip, E.strip_ws(c)), "number": (F.when(v.rlike(E.NUMBER_RE), v.try_cast("double")), E.clean_numeric_string(c)),
            "looks": (looks(c), E.looks_numeric(c)), "looks_units": (looks(F.regexp_replace(c, r"[a-zA-Z]+\s*$", "")), E.looks_numeric(c, units_ok=True)),
            "time": (F.coalesce(*[F.try_to_timestamp(strip, F.lit(f)) for f in DATETIME_FORMATS]).isNotNull(), E.parses_as_datetime(c))}


def test_same_as_the_patterns(spark):
    rows = spark.createDataFrame(_values(), "c string")
    got = rows.select("c", *[x.alias(f"{n}_{i}") for n, pair in _plain().items() for i, x in enumerate(pair)]).collect()
    for r in got:
        for n in _plain():
            if n == "time" and r.c is None:
                continue  # counted for values only
            assert r[f"{n}_0"] == r[f"{n}_1"], (n, r.c, r[f"{n}_0"], r[f"{n}_1"])
    assert sum(bool(r.time_1) for r in got) > 100


def test_values_of_no_timestamp_shape_cost_no_attempt(spark):
    rows = spark.range(300_000).select(F.concat(F.lit("word "), F.col("id").cast("string")).alias("c")).persist()
    rows.count()
    took = []
    for reads in _plain()["time"]:
        t = time.time()
        assert rows.agg(F.count_if(reads)).first()[0] == 0
        took.append(time.time() - t)
    rows.unpersist()
    assert took[1] < took[0] / 2
