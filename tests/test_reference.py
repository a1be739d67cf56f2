from pyspark.sql import functions as F

from partwright.operators import delivery, evidence, registry
from partwright.sources import reference


def test_units_and_fractions(spark):
    df = spark.createDataFrame([("IN", "inch, inches; \""), ("FT", "foot/feet"), ("", "x"), (None, None), ("PSI", None)], "u string, s string")
    assert {(r.written, r.unit) for r in reference.unit_master(df, "u", "s").collect()} == {("in", "IN"), ("inch", "IN"), ("inches", "IN"), ('"', "IN"), ("ft", "FT"), ("foot", "FT"), ("feet", "FT"), ("psi", "PSI")}
    cells = spark.createDataFrame([(["1/2", "0.5", None, "1-1/2", "1.5"],), (["0.25", "1/4"],), (["1/2", "0.5"],), ([],), (["Fraction", "Decimal"],)], "cells array<string>")
    assert {(r.fraction, r.decimal) for r in reference.fraction_pairs(cells).collect()} == {("1/2", 0.5), ("1-1/2", 1.5), ("1/4", 0.25)}


def test_files(spark, tmp_path):
    for root, names in (("a", ["x.csv", ".h/z.csv"]), ("b", ["x.csv", "sub/y.csv", "n.txt"])):
        for n in names:
            p = tmp_path / root / n
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(root)
    got = reference.find_files(spark, [str(tmp_path / "a"), str(tmp_path / "b")], "*.csv").collect()
    assert sorted(r.name for r in got) == ["x.csv", "y.csv"] and [r.path for r in got if r.name == "x.csv"][0].endswith("/a/x.csv")


def test_embedded(spark):
    body = 'var s = {"a": "}", "b": {"c": "q\\"}"}}; x window.d = {bad; window.d = {"k": 1} window.d = {"open": '
    assert reference.embedded_objects("window.s" + body, "var s") == ['{"a": "}", "b": {"c": "q\\"}"}}']
    df = spark.createDataFrame([(1, body), (2, None), (3, "")], "id bigint, b string")
    assert [(r.id, r.place) for r in reference.script_objects(df, "id", "b", "var s").collect()] == [(1, 1)]


def test_resolve_and_fuzzy(spark):
    reg = spark.createDataFrame([("M1", "MANUFACTURER", "Acme Tool Co", ["Acme"]), ("M2", "MANUFACTURER", "Acme  Tools", None), ("M3", "MANUFACTURER", "acme", [])], "record_id string, record_kind string, canonical_name string, aliases array<string>")
    asked = spark.createDataFrame([("Acme Tool Co",), ("ACME TOOL CO",), ("acme-tool, co",), ("Acme",), ("ACME",), ("Acme Tool Cob",), (None,), (" ",)], "value string")
    got = {r.value: (r.status, r.tier, r.record_id) for r in registry.resolve(asked, reg, "MANUFACTURER").collect()}
    assert got == {"Acme Tool Co": ("RESOLVED", 1, "M1"), "ACME TOOL CO": ("RESOLVED", 2, "M1"), "acme-tool, co": ("RESOLVED", 3, "M1"), "Acme": ("RESOLVED", 1, "M1"), "ACME": ("AMBIGUOUS", 2, None), "Acme Tool Cob": ("UNRESOLVED", None, None)}
    near = registry.fuzzy(asked.filter("value = 'Acme Tool Cob'"), reg, "MANUFACTURER").collect()
    assert [r.record_id for r in near][:1] == ["M1"]
    assert registry.resolve(asked.limit(0), reg, "MANUFACTURER").count() == 0


def test_conflicts_and_medians(spark):
    rows = [(1, "p", "a", "Red", 0), (2, "p", "a", " red ", 3), (3, "p", "a", "Blue", 3), (4, "p", "b", None, 0), (5, "q", "a", "x", 5), (6, "q", "a", "y", 5)]
    df = spark.createDataFrame(rows, "id bigint, p string, a string, value string, rank int")
    got = {(r.p, r.a): (r.n_values, r["values"]) for r in evidence.conflicts(df, ["p", "a"], "value", "id").collect()}
    assert got == {("p", "a"): (2, "Red | Blue"), ("q", "a"): (2, "x | y")}
    settled = {(r.p, r.a): (r.resolution, r.chosen) for r in evidence.settle(df, ["p", "a"], "value", "rank", "id").collect()}
    assert settled == {("p", "a"): ("AUTHORITATIVE", "Red"), ("q", "a"): ("REVIEW", None)}
    m = delivery.upper_median(spark.createDataFrame([("g", v) for v in (1, 2, 3, 4)] + [("h", 5), ("h", None)], "g string, v int"), "g", "v")
    assert {(r.g, r.upper_median) for r in m.collect()} == {("g", 3), ("h", 5)}
    assert [r.r for r in spark.createDataFrame([("high",), (None,), ("x",)], "a string").select(evidence.ranked_authority(F.col("a")).alias("r")).collect()] == [1, 5, 5]
