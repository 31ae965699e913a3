import itertools
import math

from pyspark.sql import functions as F

from vellumspark.functions import css_columns as C
from vellumspark.functions import css_values as V

TEXTS = (
    ["", " ", "0", "00", "-0", "+0px", "1", "1.", ".5", "1e3", "1E-2px", "1.5em", " 2em ", "2 em", "3%", "1.5rem", "pt", "4pt", "inf", "-inf", "nan", "+NaN", "Infinity", "infpx", "nanem", "1e400", "1e40px", "0x1", "1f", "1d", "1_0", "٣px", "5PX", "1.23456789em", "16777217px"]
    + ["serif", "Serif, x", "'A B', c", '"Q"', "\"'x'\"", ", ,y", "inherit", "''", "sans-serif,monospace", "É, f", "'a"]
    + ["bold", "BOLDER", "lighter", "normal", "100", "900", "950", "+400", "0400", "400.0", "1000", "700 ", "4 00"]
    + ["#fff", "#FfF", "#1234", "#123456", "#12345678", "#ggg", "#", "red", "RED", " teal", "transparent", "rebeccapurple", "#abc "]
    + ["italic", "OBLIQUE", "center", "end", "justify", "none", "disc", "upper-roman", "Lower-Alpha", "pre", "pre-line", "nowrap", "underline", "line-through", " underline ", "Normal"]
)


def test_values_are_those_of_the_kernel(spark):
    """Each text under each property, and under one that isn't known."""
    rows = [(i, n, t) for i, (n, t) in enumerate(itertools.product([*V.PARSERS, "font", "colour"], TEXTS))]
    df = spark.createDataFrame(rows, "i int, name string, text string")
    got = {r["i"]: r["v"] for r in df.select("i", C.declared(F.col("name"), F.col("text")).alias("v")).collect()}
    for i, name, text in rows:
        want = V.declared(name, text)
        mine = None if got[i] is None else (got[i]["number"], got[i]["unit"], got[i]["code"], got[i]["word"])
        if want is not None and want.number is not None and math.isnan(want.number):
            assert mine is not None and math.isnan(mine[0]) and mine[1:] == tuple(want)[1:], (name, text)
        else:
            assert mine == (None if want is None else tuple(want)), (name, text, mine, want)


def test_typed_lists(spark):
    df = spark.createDataFrame([([(0, "color", "red"), (1, "color", "what"), (2, "margin-top", "1em")],), ([],), (None,)], "d array<struct<idx: int, name: string, text: string>>")
    got = [r["x"] for r in df.select(C.typed(F.col("d")).alias("x")).collect()]
    assert [tuple(x) for x in got[0]] == [(0, "color", None, None, 0xFF0000FF, None), (2, "margin-top", 1.0, "em", None, None)] and got[1] == [] and got[2] is None


def test_the_text_of_a_plan_stays_small(spark):
    """A value is named where it is used more than once: written out at each place, one list of declarations took 336,000 characters of a plan."""
    df = spark.createDataFrame([], "d array<struct<idx: int, name: string, text: string>>").select(C.typed(F.col("d")).alias("x"))
    assert len(df._jdf.queryExecution().toString()) < 100_000
