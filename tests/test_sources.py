import zipfile

from partwright.operators import timeline
from partwright.sources import pages, tabular


def workbook(path):
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="Source" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>field_a</t></si><si><t>field_b</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Title</t></is></c></row><row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c></row><row r="3"><c r="B3"><v>4.5</v></c></row></sheetData></worksheet>')


def test_workbook(spark, tmp_path):
    p = str(tmp_path / "a.xlsx")
    workbook(p)
    rows = tabular.read_workbook(spark, p)
    assert [r.cells for r in rows.orderBy("row_number").collect()] == [["Title"], ["field_a", "field_b"], [None, "4.5"]]
    h = tabular.header_row(rows).first()
    assert (h.header_row, h.headers) == (2, ["field_a", "field_b"])


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿a,,a\n"x, ""y""\nz",2\n1,2,3,4\n', encoding="utf-8")
    df = tabular.read_csv(spark, str(p))
    assert df.columns == ["a", "__unnamed_2", "a#2", "row_hash"]
    assert [tuple(r)[:3] for r in df.collect()] == [('x, "y"\nz', "2", None), ("1", "2", "3")]
    tabular.write_ordered_csv(df, str(tmp_path / "out"), "a")
    assert tabular.file_facts(spark, str(p)).first().length == p.stat().st_size


def test_sitemap(spark):
    body = '<?xml version="1.0"?><urlset xmlns="x"><url><loc> https://a.example/1?x=1&amp;y=2 </loc></url><url><loc>https://a.example/2</loc></url></urlset>'
    df = spark.createDataFrame([(1, body), (2, "<urlset><url><loc>x"), (3, None), (4, "<sitemapindex><sitemap><loc>https://a.example/s.xml</loc></sitemap></sitemapindex>")], "id bigint, body string")
    got = [(r.id, r.kind, r.place, r["loc"]) for r in tabular.sitemap_links(df, "id", "body").orderBy("id", "place").collect()]
    assert got == [(1, "url", 1, "https://a.example/1?x=1&y=2"), (1, "url", 2, "https://a.example/2"), (4, "sitemap", 1, "https://a.example/s.xml")]


def test_pages(spark):
    html = """<html><head><title> A  b </title><meta name="Description" content="d"><link rel="canonical" href="https://a.example/p">
    <script type="application/ld+json">{"@graph": [{"@type": "Product", "sku": "S1", "brand": {"name": "Br"}}]}</script></head><body><nav>menu <a href="/n">N</a></nav>
    <p>Main text</p><table><tr><th>Weight</th><td>2 kg</td></tr></table><dl><dt>Color:</dt><dd>Red</dd></dl><img src="x.jpg" alt="pic"><script>var a = "<p>";</script></body>"""
    df = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<p>broken <b")], "page_id bigint, html string")
    got = {(r.page_id, r.fact, r.name, r.value) for r in pages.html_facts(df, "page_id", "html").collect()}
    assert {(1, "title", "", "A b"), (1, "meta", "description", "d"), (1, "canonical", "", "https://a.example/p"), (1, "product", "sku", "S1"), (1, "product", "brand.name", "Br"), (1, "pair", "Weight", "2 kg"), (1, "pair", "Color", "Red"), (1, "image", "pic", "x.jpg"), (1, "link", "N", "/n"), (1, "text", "", "Main text")} <= got
    assert not any(g[0] in (2, 3) for g in got) and not any("menu" in g[3] for g in got if g[1] == "text")


def test_timelines(spark):
    import datetime as dt

    t0 = dt.datetime(2031, 1, 1, 23, 59, 0)
    rows = [(i, "k", t0 + dt.timedelta(seconds=s), f) for i, (s, f) in enumerate([(0, True), (30, True), (59, False), (60, True), (61, True), (200, True)])]
    ev = spark.createDataFrame(rows, "event_id bigint, k string, ts timestamp_ntz, bad boolean")
    assert [r.in_window for r in timeline.rolling_load(ev, ["k"], "ts", 60).orderBy("event_id").collect()] == [1, 2, 3, 3, 4, 1]
    got = timeline.failure_streaks(ev, "k", "ts", ev.bad, 2).orderBy("event_id").collect()
    assert [r.streak for r in got] == [1, 2, 0, 1, 2, 3] and [r.state for r in got] == ["CLOSED", "OPEN", "CLOSED", "CLOSED", "OPEN", "OPEN"]
    once = timeline.load_once(ev.filter("event_id < 2"), ev.unionByName(ev), ["event_id"])
    assert sorted(r.event_id for r in once.collect()) == [2, 3, 4, 5]
    adm = timeline.admitted(ev.withColumn("w", ev.event_id * 0 + 1), "k", "ts", "w", 2, 10.0, 60).orderBy("event_id").collect()
    assert [r.admitted for r in adm] == [True, True, False, True, False, True]


def test_streams(spark, tmp_path):
    import datetime as dt

    from partwright.streaming import limits

    t0 = dt.datetime(2031, 1, 1)
    rows = [("e1", "k", t0, True), ("e2", "k", t0 + dt.timedelta(seconds=1), True), ("e2", "k", t0 + dt.timedelta(seconds=1), True), ("e3", "k", t0 + dt.timedelta(seconds=90), False)]
    src = str(tmp_path / "src")
    spark.createDataFrame(rows, "event_id string, k string, ts timestamp, bad boolean").coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema("event_id string, k string, ts timestamp, bad boolean").parquet(src)

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        return spark.table(name).collect()

    assert len(run(limits.first_only(stream(), ["event_id"], "ts"), "once", "append")) == 3
    assert [r.state for r in sorted(run(limits.breaker(stream(), "k", "ts", "bad"), "brk", "append"), key=lambda r: r.ts)][-1] == "HALF_OPEN"
    assert sum(r.n_events for r in run(limits.windowed_load(stream(), "k", "ts", 60, 60), "load", "complete")) == 4


def test_deep_product_data_is_kept():
    import json

    from partwright.sources import pages

    node = {"v": "deep"}
    for _ in range(120):
        node = {"n": [node]}
    got = pages.page_facts('<script type="application/ld+json">' + json.dumps({"@type": "Product", "name": "A", "x": node}) + "</script>")
    facts = [f for f in got if f[0] == "product"]
    assert [f[2] for f in facts] == ["A", "deep"] and facts[1][1].count(".n") == 120
