"""Operators added for delivery, links and tables: small cases with nulls, ties and empties."""

from pyspark.sql import functions as F

from partwright.functions import identifiers, text, urls
from partwright.operators import delivery, evidence, registry
from partwright.sources import tabular


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_part_number_hypotheses(spark):
    rows = [("3MABR-7100075678", "3M"), ("3MABR-7100075678", None), ("49-94-0013", "Milwaukee"), ("5B-332-080", None), (" ", "3M"), (None, None), ("AB-7100075678", "Jam Industrial Supply")]
    df = spark.createDataFrame(rows, "m string, k string").select(identifiers.mpn_hypotheses(F.col("m"), F.col("k")).alias("h"))
    got = [None if r.h is None else [(x.value, x.kind, x.confidence, x.identity_eligible) for x in r.h] for r in df.collect()]
    assert got[0] == [("3MABR-7100075678", "raw", 1.0, True), ("3MABR7100075678", "lossless_normalized", 0.98, True), ("7100075678", "verified_manufacturer_transform", 0.9, True)]
    assert got[1][2] == ("7100075678", "exploratory_prefix_strip", 0.5, False)
    assert got[2] == [("49-94-0013", "raw", 1.0, True), ("49940013", "lossless_normalized", 0.98, True), ("94-0013", "exploratory_prefix_strip", 0.5, False), ("940013", "exploratory_compact", 0.35, False)]
    assert got[4] is None and got[5] is None and got[6][2][1] == "verified_manufacturer_transform"


def test_asset_types_and_order(spark):
    rows = [("https://a.example/sds-warranty.pdf",), ("https://a.example/warranty-manual.pdf",), ("https://a.example/install.pdf",), ("https://a.example/user manual",), ("https://a.example/x.dwg",), ("https://a.example/brochure",), ("https://a.example/tds",), ("https://a.example/x",), (None,)]
    got = [r[0] for r in one(spark, rows, "u string", delivery.asset_type(F.col("u")))]
    assert got == ["sds", "warranty", "installation_manual", "user_manual", "cad_drawing", "catalog", "specification_sheet", "other_document", None]
    ranks = [r[0] for r in one(spark, [("m/manual.pdf",), ("m/spec",), ("m/wiring",), ("m/guarantee",), ("m/x.pdf",), ("m/y",)], "u string", delivery.document_rank(F.col("u")))]
    assert ranks == [1, 2, 3, 4, 5, 6]
    scope = one(spark, [("x/warranty.pdf", "A-1"), ("x/warranty-a1.pdf", "A-1"), ("x/y.pdf", None)], "u string, m string", delivery.association(F.col("u"), F.col("m")))
    assert [s[0] for s in scope] == ["MANUFACTURER_GENERAL", "PRODUCT_SPECIFIC", "PRODUCT_SPECIFIC"]


def test_contradictions(spark):
    rows = [("brushless", "a brushed motor"), ("true", "false"), ("corded", "cordless drill"), ("indoor", "indoor and outdoor"), (None, "x")]
    got = [r[0] for r in one(spark, rows, "v string, e string", text.supports(F.col("v"), F.col("e")))]
    assert got == ["CONTRADICTED", "CONTRADICTED", "CONTRADICTED", "SUPPORTED", "UNDECIDED"]


def test_links(spark):
    base = "https://a.example/p/q?x=1"
    links = ["/i.jpg", "b.pdf", "../c?d=1", "?e=2", "//cdn.example/f.js", "https://o.example/g", "mailto:x@y.example", None]
    got = [r[0] for r in one(spark, [(base, x) for x in links], "b string, l string", urls.joined(F.col("b"), F.col("l")))]
    assert got == ["https://a.example/i.jpg", "https://a.example/p/b.pdf", "https://a.example/c?d=1", "https://a.example/p/q?e=2", "https://cdn.example/f.js", "https://o.example/g", None, None]
    assert one(spark, [('var a="https:\\/\\/x.example\\/c.pdf"; b="http://y.example/d"; "http://y.example/d"',), (None,)], "s string", urls.links_in(F.col("s"))) == [(["https://x.example/c.pdf", "http://y.example/d"],), ([],)]
    assert one(spark, [("https://a.example/p?ref=1&q=2&trk_x=3&z=&utm_a=b#f",)], "u string", urls.cleaned(F.col("u"))) == [("https://a.example/p?q=2",)]
    kinds = one(spark, [("text/html; charset=x", b"%PDF-1.4"), ("application/pdf", b"<!DOCTYPE html>"), ("Text/Plain;a", b"x"), (None, None)], "h string, b binary", urls.content_type(F.col("h"), F.col("b")))
    assert [k[0] for k in kinds] == ["application/pdf", "text/html", "text/plain", None]


def test_unfenced(spark):
    rows = [('Sure:\n```json\n{"a": [1]}\n```\nbye',), ('text {"b": 2} more',), ("nothing",), (None,)]
    assert [r[0] for r in one(spark, rows, "t string", text.unfenced(F.col("t")))] == ['{"a": [1]}', '{"b": 2}', "nothing", None]


def test_brand_of_maker(spark):
    reg = spark.createDataFrame([("B1", "BRAND", "Alpha", "M1", ["A One"]), ("B2", "BRAND", "Alpha", "M1", None), ("B3", "BRAND", "Beta", "M2", None)], "record_id string, record_kind string, canonical_name string, manufacturer_id string, aliases array<string>")
    asked = spark.createDataFrame([("M1", "alpha"), ("M1", "a one"), ("M1", "beta"), ("M2", "beta"), ("M3", "beta")], "manufacturer_id string, key string")
    got = {(r.manufacturer_id, r.key): (r.record_id, r.reason) for r in registry.brand_of_maker(asked, reg).collect()}
    assert got == {("M1", "alpha"): (None, "ambiguous"), ("M1", "a one"): ("B1", "resolved"), ("M1", "beta"): (None, "unresolved"), ("M2", "beta"): ("B3", "resolved"), ("M3", "beta"): (None, "no_brands_for_manufacturer")}


def test_top_chunks_ties(spark):
    chunks = spark.createDataFrame([(1, "pump pump", 1), (2, "pump valve", 2), (3, "valve pump", 3), (4, None, 4), (5, "", 5)], "k int, t string, o int")
    terms = spark.createDataFrame([("a", "pump"), ("a", "valve")], "s string, term string")
    place = lambda **kw: [r.k for r in sorted(evidence.top_chunks(chunks, "k", "t", "o", terms, "term", "s", 3, **kw).collect(), key=lambda r: r.place)]
    assert place() == [1, 2, 3] and place(presence=True) == [3, 2, 1]


def test_upsert_keeps_what_is_there(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, v int, t string")
    tabular.upsert_parquet(first, path, ["k"], "v")
    tabular.upsert_parquet(spark.createDataFrame([("b", 2, "z"), ("c", 1, "w"), ("a", 0, "old")], "k string, v int, t string"), path, ["k"], "v")
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("a", 1, "x"), ("b", 2, "z"), ("c", 1, "w")]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_images(spark):
    df = spark.createDataFrame([(1, "AB1", ["u/logo.png", "u/1.jpg", "u/ab1.jpg", "u/1.jpg", None]), (2, None, None)], "k int, m string, i array<string>")
    got = sorted((r.place, r.url, r.role) for r in delivery.ranked_images(df, "k", "i", "m").collect())
    assert got == [(1, "u/ab1.jpg", "PRIMARY"), (2, "u/1.jpg", "ALTERNATE")]


def test_category_tiers(spark):
    rules = spark.createDataFrame([("tools > saws", "saws", 1), ("tools > drills", "drills", 2), ("paint", "paint", 3)], "path string, leaf string, rule_id int")
    asked = spark.createDataFrame([("Tools > Saws",), ("Shop > Tools > Saws > Big",), ("Garden > Drills",), ("House Paints",), ("Nothing",)], "classpath string")
    got = {r.classpath: (r.tier, r.rule_id) for r in registry.category_rules(asked, rules).collect()}
    assert got == {"Tools > Saws": (1, 1), "Shop > Tools > Saws > Big": (2, 1), "Garden > Drills": (3, 2), "House Paints": (2, 3), "Nothing": (None, None)}


def test_running_sums_and_sessions(spark):
    import random

    from partwright.operators import timeline

    rnd = random.Random(2)
    rows = [(i, rnd.choice(["a", "b", None]), 1_700_000_000 + rnd.randrange(40) * 40_000, rnd.choice([1.0, 2.5, None])) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id int, user string, s bigint, value double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.event_id: r for r in timeline.sessions(timeline.running_sum(df, "user", "ts", "event_id", F.col("value")), "user", "ts", 86_400).collect()}
    for user in ("a", "b", None):
        total, session, last = None, 0, None
        for i, _, s, v in sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0])):
            total = v if total is None else total + (v or 0)
            session += last is not None and s - last > 86_400
            last = s
            assert got[i].running == total and got[i].session == session
