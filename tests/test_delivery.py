import json
import os

import duckdb
import pytest

from partwright.operators import delivery
from partwright.plans import catalog, catalogue, matching

FIVE = "map('Size', '7/8 in', 'Amps', '9.5 Amps', 'Blank', ' ', 'Type', 'Planer', 'None', null, 'Grit', '120', 'Arbor', '22.23 mm')"


@pytest.fixture(scope="module")
def golden(spark):
    return spark.sql(f"SELECT 1L AS record_id, {FIVE} AS expected_attributes UNION ALL SELECT 2L, null UNION ALL SELECT 3L, map_filter({FIVE}, (k, v) -> false)")


def test_slots_have_label_value_and_uom_in_the_order_written(golden):
    r = {x.record_id: x for x in delivery.attribute_slots(golden, "record_id", "expected_attributes", 3).collect()}
    assert [r[1][f"{c}_{i}"] for i in (1, 2, 3) for c in ("label", "value", "uom")] == ["Size", "7/8", "in", "Amps", "9.5", "Amps", "Type", "Planer", None]
    assert (r[1].n_attributes, r[2].n_attributes, r[3].n_attributes) == (5, 0, 0)
    assert r[2].label_1 is None


def test_attributes_beyond_the_last_slot_come_as_rows(golden, spark, data):
    assert [tuple(x) for x in delivery.beyond_slots(golden, "record_id", "expected_attributes", 3).orderBy("place").collect()] == [(1, 4, "Grit", "120", None), (1, 5, "Arbor", "22.23", "mm")]
    c = duckdb.connect()
    e = f"(SELECT * FROM '{data}/expected_products.parquet')"
    want = sorted(c.execute(catalogue.beyond_sql(3, e)).fetchall(), key=str)
    df = spark.read.parquet(f"{data}/expected_products.parquet")
    assert want and sorted((tuple(x) for x in delivery.beyond_slots(df, "record_id", "expected_attributes", 3).collect()), key=str) == want


def test_no_attribute_is_lost_between_slots_and_rows(spark, data):
    q = catalog.queries()
    wide, more = q["P3_attribute_slots"](spark, data), q["P3_beyond_slots"](spark, data).count()
    assert [c for c in wide.columns if c.startswith("uom_")][-1] == "uom_50"
    given = spark.read.parquet(os.path.join(data, "expected_products.parquet")).selectExpr("explode(expected_attributes) AS (k, v)").filter(r"v rlike '\\S'").count()
    filled = sum(sum(r[f"label_{i}"] is not None for i in range(1, 51)) for r in wide.collect())
    assert filled + more == given


def test_payload_holds_every_value_and_the_sources(spark):
    attributes = "map('Size', '7/8 in', 'Amps', '9.5 \"A\"', 'None', null)"
    products = spark.sql(f"SELECT 1L AS record_id, 'p1' AS product_id, 'M-1' AS mpn, 'Pelrimar' AS manufacturer, {attributes} AS expected_attributes UNION ALL SELECT 2L, null, null, null, null")
    captures = spark.createDataFrame(
        [(8, "p1", "https://b.example", "MANUAL", None, None), (7, "p1", "https://a.example", "PAGE", "MAKER", "Blade of 7/8 in"), (9, "p1", None, "PAGE", None, "7/8 in")],
        "context_id bigint, product_id string, canonical_product_url string, source_type string, source_authority string, page_text string",
    )
    got = {r.record_id: json.loads(r.payload) for r in matching.payloads(products, captures).collect()}
    assert got[1]["product"] == {"Amps": '9.5 "A"', "Manufacturer": "Pelrimar", "Size": "7/8 in"} and list(got[1]["product"]) == sorted(got[1]["product"])
    assert got[1]["sources"] == [{"url": "https://a.example", "type": "PAGE", "authority": "MAKER", "evidence": ["7/8 in"]}, {"url": "https://b.example", "type": "MANUAL", "authority": None, "evidence": []}]
    assert got[2] == {"record_id": 2, "product_id": None, "mpn": None, "product": {}, "sources": []}
