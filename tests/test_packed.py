from partwright.operators import packed

KNOWN = ["Heating / Cooling", "Kits, Assorted", '18" Cutters', "Tools", "Blades > 10 in", "Pro/Contractor", "Metric", "Safety", "Gloves"]


def split(spark, rows):
    df = spark.createDataFrame(rows, "row_id bigint, classpath string, node_value string, segments int")
    got = packed.split_packed(df, "row_id", "classpath", KNOWN).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.row_id, r.node_no)):
        out.setdefault(r.row_id, []).append(r.node_value)
        assert r.node_no == len(out[r.row_id])
    return out


def test_delimiters_quotes_and_escapes(spark):
    cases = {
        1: ("Heating / Cooling / Metric", ["Heating / Cooling", "Metric"]), 2: ('Tools > "Blades > 10 in" > Metric', ["Tools", "Blades > 10 in", "Metric"]),
        3: ("Tools>Blades \\> 10 in>Metric", ["Tools", "Blades > 10 in", "Metric"]), 4: ('"Tools" > "18"" Cutters"', ["Tools", '18" Cutters']),
        5: ("Tools\\Kits, Assorted\\'Pro/Contractor'", ["Tools", "Kits, Assorted", "Pro/Contractor"]), 6: ("Safety > Gloves >> Metric", ["Safety", "Gloves", "Metric"]),
        7: (" >  > Safety |  | Gloves > ", ["Safety", "Gloves"]), 8: ("Tools::Pro\\/Contractor", ["Tools", "Pro/Contractor"]), 9: ("Alpha One > Beta, Two > Gamma", ["Alpha One", "Beta, Two", "Gamma"]),
        10: ("Safety\tGloves", ["Safety", "Gloves"]), 11: ('Tools\\"18"" Cutters"\\Metric', ["Tools", '18" Cutters', "Metric"]),
    }
    got = split(spark, [(k, v[0], "x", 1) for k, v in cases.items()] + [(20, None, "x", 1), (21, "  ", "x", 1), (22, "Safety;Gloves", "x", 1), (22, "Safety;Gloves", "x", 1)][:3])
    assert {k: got[k] for k in cases} == {k: v[1] for k, v in cases.items()}
    assert 20 not in got and 21 not in got and got[22] == ["Safety", "Gloves"]


def test_empty_long_and_repeated(spark):
    assert split(spark, []) == {}
    long = " > ".join(["Safety", "Gloves"] * 2000)
    got = split(spark, [(1, long, None, None), (2, "Safety", None, None), (3, "Safety", None, None)])
    assert len(got[1]) == 4000 and got[2] == got[3] == ["Safety"]


def test_known_nodes_only_on_data(spark, data):
    from partwright.plans.preparation import p3_found
    from partwright.session import table

    known = set(packed.known_names(table(spark, data, "lov_rules")))
    assert {r.node_value for r in p3_found(spark, data).select("node_value").distinct().collect()} <= known
