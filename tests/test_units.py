import pytest
from hypothesis import given
from hypothesis import strategies as st

from partwright.operators import units

CASES = [
    ("Diameter", "7 - 8 in", None, [177800000, 203200000]), ("Diameter", "397.1 mm [15.63 in]", None, [397100000]), ("Diameter", "2 ft. 9 in.", None, [838200000]), ("Diameter", "4-15/32″", None, [113506250]),
    ("Diameter", "327.1 mm +/- 0.05 mm", None, [327100000]), ("Diameter", "14 ga", None, []), ("Diameter", "12.943", "in", [328752200]), ("Diameter", "12.943", None, []), ("Diameter", "nine-inch", None, [228600000]),
    ("Diameter", "8½ Inch", None, [215900000]), ("Diameter", "254,8 mm", None, [254800000]), ("Diameter", "varies by model", "mm", []), ("Thickness", "half an inch", None, [12700000]), ("Thickness", "three-eighths inch", None, [9525000]),
    ("Thickness", "0.9mm / 0.04\"", None, [900000]), ("Thickness", "2,870 micrometers", None, [2870000]), ("Thickness", ".213 inches", None, [5410200]), ("No Load Speed", "0-900 / 0-3,800 RPM", None, [0, 900, 0, 3800]),
    ("No Load Speed", "18.0 x 1000/min", None, [18000]), ("No Load Speed", "20.8k RPM", None, [20800]), ("No Load Speed", "10.6 krpm", None, [10600]), ("No Load Speed", "max. 8 800rpm", None, [8800]),
    ("No Load Speed", "1st gear 3000 / 2nd gear 6000 r/min", None, [3000, 6000]), ("No Load Speed", "43 m/s rim", "rpm", []), ("No Load Speed", "115.7 revolutions per second", None, [6942]), ("No Load Speed", "up to 700 min-1", None, [700]),
    ("Feed Speed", "two-speed: 18 and 21 ft/min", None, [5486400, 6400800]), ("Feed Speed", "45 cuts per inch", "ft/min", []), ("Feed Speed", "47'/min", None, [14325600]), ("Feed Speed", "19,5 m/min", None, [19500000]),
]


@pytest.mark.parametrize("name,text,hint,expected", CASES)
def test_values(name, text, hint, expected):
    assert [r[0] for _, r in units.read_value(name, text, hint)] == expected


def test_notes():
    assert units.note_units("sizes: millimetres. No-load values are rpm") == {"length": "mm", "rotation": "rpm"}
    assert units.note_units("All lengths given in in. unless stated") == {"length": "in"}
    assert units.note_units("Feed rate unit: ft/min / Maße in cm") == {"feed": "ft/min", "length": "cm"}
    assert units.note_units(None) == {} and units.note_units("Weight without cord") == {}


@given(st.text(max_size=40))
def test_any_text_is_read(text):
    for name in units.QUANTITIES:
        assert [n for n, _ in units.read_value(name, text, "mm" if name in ("Diameter", "Thickness") else None)] == list(range(1, 1 + len(units.read_value(name, text, "mm" if name in ("Diameter", "Thickness") else None))))


@given(st.integers(1, 99999), st.sampled_from(["mm", "in", "cm"]))
def test_round_trip(n, unit):
    assert units.read_value("Diameter", f"{n / 100:.2f} {unit}", None)[0][1][0] == n * units.LENGTH[unit] // 100


ARGS = ("record_id", "expected_attributes", "spec_note", "source_feed", "product_id")
SCHEMA = "record_id bigint, expected_attributes map<string,string>, spec_note string, source_feed string, product_id string, common_value int"


def test_measured_values_edges(spark):
    rows = [(1, {"Diameter": "5 mm"}, None), (2, None, "sizes: mm"), (3, {"Diameter": None, "Thickness": " "}, None), (4, {"Diameter": "7"}, "sizes: cm"), (5, {"Diameter": "7"}, "sizes: cm")]
    got = units.measured_values(spark.createDataFrame([(*r, "f", None, 9) for r in rows], SCHEMA), *ARGS).collect()
    assert sorted((r.record_id, r.common_value) for r in got) == [(1, 5000000), (4, 70000000), (5, 70000000)]
    assert units.measured_values(spark.createDataFrame([], SCHEMA), *ARGS).count() == 0


def test_open_readings_are_settled_by_identities(spark):
    rows = [(i, {"No Load Speed": f"{900 + 10 * i} rpm"}, "f", f"p{i}") for i in range(30)]
    rows += [(100, {"No Load Speed": "1.250 rpm"}, "f", "q"), (101, {"Thickness": "2,870 micrometers"}, "f", "q"), (102, {"Diameter": "1.250 m / 49.21 in"}, "f", "q")]
    rows += [(103, {"Feed Speed": "1.524 m/min"}, "f", "r"), (104, {"Feed Speed": "1524 m/min"}, "g", "r"), (105, {"Feed Speed": "1.524 m/min"}, "f", "s")]
    got = {(r.record_id, r.attribute_name): (r.common_value, r.unique_solution) for r in units.measured_values(spark.createDataFrame([(i, a, None, f, p, 0) for i, a, f, p in rows], SCHEMA), *ARGS).collect()}
    assert got[(100, "No Load Speed")] == (1250, True)  # its source's other speeds are of that size
    assert not got[(101, "Thickness")][1]  # two readings and nothing to compare them with
    assert got[(102, "Diameter")] == (1_250_000_000, True)  # restated in a second unit
    assert got[(103, "Feed Speed")] == (1_524_000_000, True)  # another record of the product says so


def test_readings_that_tie(spark):
    rows = [(i, {"Thickness": "31.6227766 mm"}, None, "f", f"p{i}", 0) for i in range(30)] + [(99, {"Thickness": "1,000 mm"}, None, "f", "q", 0)]
    got = {r.record_id: r.unique_solution for r in units.measured_values(spark.createDataFrame(rows, SCHEMA), *ARGS).collect()}
    assert not got[99] and all(got[i] for i in range(30))


def test_source_units_by_identity(spark):
    rows = [("a", 2.0 * i, 1000.0 * i, 2.0) for i in range(1, 9)] + [("b", 2000.0 * i, 1.0 * i, 2.0) for i in range(1, 9)] + [("c", None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "feed string, mass double, volume double, density double")
    columns = {"mass": {"kg": 1.0, "g": 0.001}, "volume": {"l": 1.0, "ml": 0.001}, "density": {"kg_per_l": 1.0}}
    got = {(r.source, r.column): (r.unit, r.unique_solution) for r in units.resolve_source_units(df, "feed", columns, [{"mass": 1, "density": -1, "volume": -1}]).collect()}
    assert got[("a", "volume")] == ("ml", True) and got[("a", "mass")] == ("kg", True) and got[("b", "mass")] == ("g", True) and got[("c", "mass")][0] is None
    tied = units.resolve_source_units(df.filter("feed = 'a'").withColumn("volume", df.mass / 2), "feed", columns, [{"mass": 1, "density": -1, "volume": -1}])
    assert not any(r.unique_solution for r in tied.collect() if r.column != "density")
