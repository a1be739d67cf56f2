import json

import pytest

from partwright.operators import nested
from partwright.session import table


COLUMNS = ["run_id", "trace_no", "child_table", "parent_no", "child_no", "child_value"]


def brute(rows):
    def lst(v):
        if isinstance(v, str) and v[:1] in "[{":
            v = json.loads(v)
        return [] if v is None else v if isinstance(v, list) else [v]

    out = set()
    for run, p in rows:
        try:
            j = json.loads((p or "").lstrip("﻿"))
        except ValueError:
            continue
        for n, x in enumerate(lst(j.get("traces", (j.get("report") or {}).get("traces"))), 1):
            found = [("phase4", 0, 1, q.get("status")) for q in lst(x.get("phase4"))[:1]]
            for q in lst(x.get("input_brand_fields")):
                found.append(("brand", 0, 1, q["Unilog_Brand"] if "Unilog_Brand" in q else q.get("value") if q.get("name") == "Unilog_Brand" else None))
            p5 = x.get("phase5") or {}
            found += [("domain_candidate", 0, i, q if isinstance(q, str) else q.get("domain")) for i, q in enumerate(lst(p5.get("domain_candidates")), 1)]
            for i, q in enumerate(lst(p5.get("documents")), 1):
                found.append(("document", 0, i, q.get("document_id")))
                found += [("chunk", i, k, c.get("chunk_id")) for k, c in enumerate(lst(q.get("chunks")), 1)]
            out |= {(run, n, *f) for f in found if f[3] is not None}
    return out


def test_same_as_brute_force(spark, data):
    t = table(spark, data, "trace_runs")
    got = {tuple(r) for r in nested.flatten_traces(t).select(*COLUMNS).collect()}
    assert got == brute([(r.run_id, r.payload) for r in t.collect()]) and got


def test_shapes(spark):
    one = {"traces": {"phase4": [{"status": "OK"}], "input_brand_fields": json.dumps({"Unilog_Brand": "A"}), "phase5": {"domain_candidates": ["x.example", {"domain": None}, {"domain": "y.example"}], "documents": [{"chunks": [{"chunk_id": "c"}]}]}}}
    rows = [(1, json.dumps(one)), (2, json.dumps({"report": {"traces": [one["traces"]]}})), (3, json.dumps(one)[:-5]), (4, json.dumps(one) + " x"), (5, None), (6, ""), (7, '{"a": 1},{"b": 2}'), (8, '{"traces": null}'), (9, "[]")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "run_id bigint, payload string, doc string")
    got = {tuple(r) for r in nested.flatten_traces(df).select(*COLUMNS).collect()}
    assert got == brute(rows[:2]) and {g[0] for g in got} == {1, 2}
    empty = spark.createDataFrame([], "run_id bigint, payload string")
    assert nested.flatten_traces(empty).count() == 0


def test_links(spark, data):
    flat = nested.flatten_traces(table(spark, data, "trace_runs")).withColumnRenamed("trace_no", "record_no")
    docs = {r.row_key for r in nested.child_table(flat, "run_id", "document").collect()}
    chunks = nested.child_table(flat, "run_id", "chunk").collect()
    assert chunks and all(c.parent_key in docs for c in chunks)


def test_places():
    s = "OBJECT<report: OBJECT<traces: ARRAY<OBJECT<traces: STRING>>>, traces: VARIANT, `odd: name`: DECIMAL(3,1), x: ARRAY<ARRAY<BIGINT>>>"
    found = [(tuple(json.loads(p)), k) for p, k in nested.places_in(s)]
    assert nested.record_places(found, "traces") == [("report", "traces"), ("traces",)] and nested.places_in("") == []
    assert (("x", "[]"), "ARRAY") in found and (("odd: name",), "VALUE") in found


def test_three_levels_have_unique_keys(spark):
    rows = [{"a": [{"b": [{"c": [1, 2]}, {"c": [3]}]}, {"b": [{"c": [4, 5]}]}], "s": ["u", None]}, {"a": {"b": [{"c": [6]}]}}]
    df = spark.createDataFrame([(7, json.dumps({"rec": rows}), "x"), (8, json.dumps({"rec": []}), "x")], "k bigint, p string, ordinals string")
    got = nested.linked(nested.flatten_records(df, "k", "p", "rec"), "k").collect()
    keys = {(r.child_table, r.row_key) for r in got}
    assert len(keys) == len(got) and {r.child_table for r in got} == {"a", "a.b", "a.b.c", "s"}
    assert sorted(r.child_value for r in got if r.child_table == "a.b.c") == list("123456")
    above = {"a.b": "a", "a.b.c": "a.b"}
    assert all((above[r.child_table], r.parent_key) in keys for r in got if r.child_table in above)


def test_arrays_above_the_records(spark):
    one = {"traces": [{"phase4": {"status": "OK"}}, {"phase4": {"status": "B"}}]}
    rows = [(1, json.dumps([one, {"x": 1}, one])), (2, json.dumps({"runs": [one]}))]
    got = {(r.run_id, r.trace_no, r.child_value) for r in nested.flatten_traces(spark.createDataFrame(rows, "run_id bigint, payload string")).collect()}
    assert got == {(1, 1, "OK"), (1, 2, "B"), (1, 3, "OK"), (1, 4, "B"), (2, 1, "OK"), (2, 2, "B")}


def test_keys_that_are_data(spark, monkeypatch):
    monkeypatch.setattr(nested, "MAX_PLACES", 50)
    df = spark.createDataFrame([(i, json.dumps({f"k{i}": 1})) for i in range(60)], "run_id bigint, payload string")
    with pytest.raises(ValueError):
        nested.flatten_traces(df)
