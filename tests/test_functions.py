import math
import time
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from partwright.functions import identifiers, numbers, text, urls
from partwright.operators import profile


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'bigint'}" for k, v in values.items()))
    return df.select(expr.alias("r")).first()["r"]


def test_normalized(spark):
    df = spark.createDataFrame([(None,), ("",), (" x ",), ("-- Unbranded --",), ("y",)], "v string")
    got = [tuple(r.n) for r in df.select(text.normalized(F.col("v")).alias("n")).collect()]
    assert got == [(None, "null"), (None, "blank"), ("x", "trimmed"), (None, "placeholder"), ("y", None)]


def test_nfkc(spark):
    df = spark.createDataFrame([("ﬁt½",), (None,)], "v string")
    assert [r.x for r in df.select(text.nfkc(F.col("v")).alias("x")).collect()] == ["fit1⁄2", None]


def test_hypotheses(spark):
    h = one(spark, identifiers.mpn_hypotheses(F.col("m")), m="3MABR-7100075678")
    assert [(x.value, x.kind) for x in h] == [("3MABR-7100075678", "raw"), ("3MABR7100075678", "lossless_normalized"), ("7100075678", "exploratory_prefix_strip")]


def test_urls(spark):
    cases = {
        "HTTPS://Www.Shop.Example.:443/a?utm_source=1&b=2&gclid=3#top": "https://www.shop.example/a?b=2", "http://x.example:80": "http://x.example/", "http://x.example:8080/?": "http://x.example:8080/",
        "ftp://x.example/": None, "http://localhost/a": None, "http://192.168.1.4/": None, "http://172.20.0.1/": None, "": None, "no url": None,
    }
    df = spark.createDataFrame(list(cases.items()), "u string, e string")
    assert all(r.c == r.e for r in df.select(urls.canonical(F.col("u")).alias("c"), "e").collect())


def test_supports(spark):
    cases = [("cordless", "a corded tool", "CONTRADICTED"), ("4-1/2 in", "wheel 4-1/2 in wide", "SUPPORTED"), ("7,500 rpm", "runs at 7500 per minute", "SUPPORTED"), ("9 in", "8 in", "REJECTED"), ("steel blade", "blade made of steel", "SUPPORTED"), ("red", "blue", "UNDECIDED"), (None, "x", "UNDECIDED")]
    df = spark.createDataFrame(cases, "v string, e string, r string")
    assert all(x.got == x.r for x in df.select(text.supports(F.col("v"), F.col("e")).alias("got"), "r").collect())


def test_truncate(spark):
    df = spark.createDataFrame([(["ab", "cd", "ef"],), (["abcdefgh"],), ([],)], "p array<string>")
    assert [r.t for r in df.select(text.truncate_words(F.col("p"), 6).alias("t")).collect()] == ["ab, cd", "abcdef", ""]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(0, 500), min_size=1, max_size=20))
def test_fractions_are_nearest(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", numbers.double_to_fraction(F.col("x")).alias("f")).collect():
        whole, _, part = r.f.rpartition("-") if "/" in r.f else (r.f, "", "0")
        near = Fraction(whole or 0) + Fraction(part)
        best = min(abs(Fraction(r.x) - Fraction(round(Fraction(r.x) * d), d)) for d in range(1, 65))
        assert abs(float(abs(near - Fraction(r.x)) - best)) < 1e-9


def test_fractions_of_many_rows(spark):
    df = spark.range(20_000).select((F.col("id") / 1250).alias("x")).union(spark.createDataFrame([(-1.0,), (float("nan"),), (float("inf"),), (None,)], "x double"))
    began = time.monotonic()
    got = [r.f for r in df.select(numbers.double_to_fraction(F.col("x")).alias("f")).collect()]
    assert time.monotonic() - began < 20
    assert got[-4:] == [None] * 4
    for i, f in enumerate(got[:-4]):
        x = i / 1250
        off, d, n = min((abs(x % 1 - n / d), d, n) for d in range(1, 65) for n in [math.floor(x % 1 * d + 0.5)])
        w = int(x) + (n == d)
        assert f == (str(w) if n in (0, d) else f"{w}-{n}/{d}" if w else f"{n}/{d}")


def test_headers():
    assert profile.unique_headers([" a ", "", "a", None, "a"]) == ["a", "__unnamed_2", "a#2", "__unnamed_4", "a#3"]
    assert profile.header_check(["first", "second"], ["second", "unexpected"]) == {"valid": False, "missing": ["first"], "unexpected": ["unexpected"], "duplicate": [], "order_changed": False}
    assert profile.header_check(["a", "b"], ["b", "a"])["order_changed"] and profile.header_check(["a", "b"], ["a", "b"])["valid"]
