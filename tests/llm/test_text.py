"""Operators for training text: planted cases, brute force, round trips, edges."""

import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from partwright.llm import canonical, catalog, leakage, mainbody, packing, residue, subjects, truncation


def test_queries_have_their_columns(spark, data):
    columns = {
        "p2_found": ["row_id", "field_name"], "p5_found": ["row_id", "field_name", "canonical_id"], "p6_found": ["table_name", "record_id", "field_name"], "p7_found": ["context_id", "line_no"],
        "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "subject_id"],
    }
    for name, names in columns.items():
        df = catalog.queries()[name](spark, data)
        assert df.columns == names and df.count() == df.distinct().count() > 0, name


def test_unclosed_and_broken(spark):
    cases = [("a (b", True), ("a (b) c", False), ("x [y (z]", True), ("<b>bold</b>", False), ("<b>bold", True), ("line<br>two", False), ("cut &am", True), ("Black & Decker", False), ("cut <b", True), ("wait...", True), ("caf�", True), ('7/8"', False), ("a) b", False), ("ends Ltd.", False)]
    df = spark.createDataFrame(cases, "t string, e boolean")
    assert [(r.t, r.got) for r in df.select("t", truncation.broken_end(F.col("t")).alias("got")).collect()] == cases


def test_truncated(spark):
    full = ["Steel Bolt Galv", "Sump Pump Clear Finish", "Nail Gun Left Hand"]
    rows = []
    for i in range(60):
        d = f"A-{i:03d} {full[i % 3]}"
        rows.append((i, "f", d, f"MAKER A-{i:03d} {d}".upper(), f"Maker A-{i:03d} {d}", f"Brand A-{i:03d}, {d}", f"A-{i:03d}", "x"))
    rows += [
        (100, "f", "A-100 Steel Bolt Ga", "MAKER A-100 A-100 STEEL BOLT GALV", "Brand A-100 Steel Bolt Galv (A-1", None, "A-100", "x"), (101, "f", None, "", "  ", None, None, "x"),
        (102, "f", "A-102 Sump Pump Cle", None, None, None, "A-102", "x"), (103, "f", "A-103 Nail Gun…", "MAKER A-103 A-103 NAIL GUN LEFT", None, "Brand A-103, A-103 Nail Gun Left Hand", "A-103", "x"),
    ]
    schema = "row_id bigint, feed_source string, part_desc string, invoice_desc string, mobile_desc string, short_desc string, mfg_part_num string, token string"
    args = ("row_id", "feed_source", "part_desc", {"invoice_desc": False, "mobile_desc": True}, "short_desc", "mfg_part_num")
    got = {(r.row_id, r.field_name) for r in truncation.truncated(spark.createDataFrame(rows, schema), *args).filter("is_cut").collect()}
    assert got == {(100, "part_desc"), (100, "mobile_desc"), (102, "part_desc"), (103, "part_desc"), (103, "invoice_desc")}
    assert truncation.truncated(spark.createDataFrame([], schema), *args).count() == 0


def test_unclosed_quotes_apart_from_inch_marks(spark):
    cases = [('the "Big', True), ('the "Big" one', False), ('18" blade', False), ('Blade 7/8"', False), ('"size 5"', False), ('kit ("A" and "B', True), ("“Big", True), ("“Big”", False), ('a 5 " b', False)]
    df = spark.createDataFrame(cases, "t string, e boolean")
    assert [(r.t, r.got) for r in df.select("t", truncation.broken_end(F.col("t")).alias("got")).collect()] == cases


def test_terminators_are_those_of_the_source(spark):
    def rows(source, start, n, end):
        return [(start + i, source, f"A-{start + i} Steel Bolt {end}", f"MAKER A-{start + i} STEEL BOLT {end.upper()}", None, f"Brand A-{start + i}, A-{start + i} Steel Bolt {end}", f"A-{start + i}", "x") for i in range(n)]

    asked = [(90001, "small", "A-90001 Hex Nut Zinkweiss", None, None, None, "A-90001", "x"), (90002, "large", "A-90002 Hex Nut Zinkweiss", None, None, None, "A-90002", "x"), (90003, "other", "A-90003 Hex Nut Galv", None, None, None, "A-90003", "x"), (90004, "other", "A-90004 Hex Nut Hand", None, None, None, "A-90004", "x"), (90005, "new", "A-90005 Hex Nut Galv", None, None, None, "A-90005", "x")]
    # small's own ending lies below MIN_SHARE of all endings; Galv is an ending of large alone; new has no proven value
    data = rows("large", 10000, 16000, "Galv") + rows("small", 50000, 3, "Zinkweiss") + rows("other", 60000, 300, "Hand") + asked
    schema = "row_id bigint, feed_source string, part_desc string, invoice_desc string, mobile_desc string, short_desc string, mfg_part_num string, token string"
    args = ("row_id", "feed_source", "part_desc", {"invoice_desc": False, "mobile_desc": True}, "short_desc", "mfg_part_num")
    got = {(r.row_id, r.field_name) for r in truncation.truncated(spark.createDataFrame(data, schema), *args).filter("is_cut").collect()}
    assert got == {(90002, "part_desc"), (90003, "part_desc")}


def test_aligned_invoice_is_proven(spark):
    d = "Steel Bolt Galv"
    rows = [(i, "f", d, f"MAKER {d}".upper(), None, f"Brand A-{i}, {d}", f"A-{i}") for i in range(9)] + [(20, "f", "Steel Bolt Brass", "MAKER STEEL BOLT BRASS", None, "Brand A-20, Steel Bolt Brass", "A-20")]
    df = spark.createDataFrame(rows, "row_id bigint, feed_source string, part_desc string, invoice_desc string, mobile_desc string, short_desc string, mfg_part_num string")
    got = truncation.truncated(df, "row_id", "feed_source", "part_desc", {"invoice_desc": False, "mobile_desc": True}, "short_desc", "mfg_part_num")
    assert got.filter("is_cut").count() == 0 and got.filter("field_name = 'invoice_desc' and proven").count() == 10


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
    return row[-1]


def _changed(rnd, t, n):
    for _ in range(n):
        i, kind = rnd.randrange(len(t)), rnd.choice("dis")
        t = t[:i] + ("" if kind == "d" else rnd.choice("abcdxyz")) + t[i + (kind != "i") :]
    return t


def test_links_against_brute_force(spark):
    rnd = random.Random(4)
    known = ["access denied", "page not found", "service temporarily unavailable", "please enable javascript to view this site", "unbranded", "no brand name"]
    texts = sorted({_changed(rnd, t, rnd.randint(1, 6)).strip() for t in known for _ in range(80)} - set(known))
    near = lambda a, b: _distance(a, b) <= 0.15 * max(len(a), len(b)) + 1e-9
    want = {b for b in texts for a in known if near(a, b)}
    index = residue.prints(spark.createDataFrame([(t,) for t in texts], "unit string"))
    asked = residue.prints(spark.createDataFrame([(t,) for t in known], "unit string"))
    got = {r.unit for r in residue.near_units(asked, index.select("unit", "print", F.explode("keys").alias("key"))).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) > 100


def test_planted_changes_and_hidden_phrases_come_back(spark):
    rnd = random.Random(9)
    known = [t for t in residue.TRUSTED if len(t) >= 7]
    planted = [_changed(rnd, t, 1).strip() for t in known]
    good = ["falnofors", "lumno lund", "robot arm timer", "nonesuch hardware", "7x-641-060 carriage bolt", "epoxy primer"]
    found = spark.createDataFrame([(t,) for t in planted + good], "t string").select(residue.core(F.col("t")).alias("unit"))
    got = {r.unit for r in residue.spread_labels(found).collect()}
    back = [r.unit for r in spark.createDataFrame([(t,) for t in planted], "t string").select(residue.core(F.col("t")).alias("unit")).collect()]
    assert sum(u in got for u in back) >= 0.9 * len(back) and not set(good) & got
    # the phrase is hidden and only a misspelt form of it is trusted: the right form comes back
    half = rnd.sample(known, len(known) // 2)
    hidden = spark.createDataFrame([(t,) for t in half], "t string").select(residue.core(F.col("t")).alias("unit"))
    got = {r.unit for r in residue.spread_labels(hidden, [_changed(rnd, t, 1) for t in half]).collect()}
    assert len(got) >= 0.9 * hidden.distinct().count()


def test_edits_against_definition():
    def slow(a, b):
        if not a or not b:
            return len(a) + len(b)
        best = min(slow(a[1:], b) + 1, slow(a, b[1:]) + 1, slow(a[1:], b[1:]) + (a[0] != b[0]))
        if len(a) > 1 and len(b) > 1 and a[0] == b[1] and a[1] == b[0]:
            best = min(best, slow(a[2:], b[2:]) + 1)
        return best

    rnd = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 5))) for _ in "ab")
        assert canonical.edits(a, b) == slow(a, b)


def test_repair_is_complete(spark):
    rnd = random.Random(2)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.choice([4, 6, 8, 39, 41, 90]))) for _ in range(90)]
    asked = set()
    for w in vocabulary:
        t = list(w)
        for _ in range(rnd.randint(0, 2)):
            i = rnd.randrange(len(t))
            t[i : i + 1] = rnd.choice([[], ["z"], [t[i], t[i]]])
        asked.add("".join(t) or "z")
    got = {(r.token, r.ref, r.n) for r in canonical.repair_tokens(spark.createDataFrame([(a,) for a in asked], "token string"), spark.createDataFrame([(v,) for v in set(vocabulary)], "ref string")).collect()}
    allowed = lambda a, b: (min(len(a), len(b)) >= 7) + (min(len(a), len(b)) >= 5)
    assert got == {(a, v, canonical.edits(a, v)) for a in asked for v in vocabulary if canonical.edits(a, v) <= allowed(a, v)}


REGISTRY = [("M1", "MANUFACTURER", "Falnofors Industries LLC", "4584", None, ["Rudzopard Safety"]), ("M2", "MANUFACTURER", "Pelrimar Supply Co", "PELRI", None, []), ("M3", "MANUFACTURER", "Kornovane & Qualapard Supply Inc", "KORNO", None, None), ("B1", "BRAND", "Lumnolund", "BR-7085", "M1", ["ULM-5X"]), ("B2", "BRAND", "Vorvequist Home", "BR-1", "M2", [])]


def test_names(spark):
    reg = spark.createDataFrame(REGISTRY, "record_id string, record_kind string, canonical_name string, code string, manufacturer_id string, aliases array<string>")
    cases = [
        ("Falnofors Industries LLC (4584)", "M1"), ("supply pelrimar", "M2"), ("4584", "M1"), ("Mfr 4584", "M1"), ("Fanofrs Industries LLC", "M1"), ("FALNOFORS", "M1"), ("F4ln0f0rs Industries", "M1"), ("Rudzopard Safety *dropship*", "M1"),
        ("KornovaneQualapardSupplyInc", "M3"), ("Fenkyvane Supply Co (X312)", "UNMATCHED"), (None, None), (" ", None), ("TBD", None), ("-- Unbranded --", None),
    ]
    df = spark.createDataFrame([(i, c[0], "v") for i, c in enumerate(cases)], "row_id bigint, part_manuf string, value string")
    got = {r.row_id: r.canonical_id for r in canonical.map_names(df, "row_id", {"part_manuf": "MANUFACTURER"}, reg).collect()}
    assert [got.get(i) for i in range(len(cases))] == [c[1] for c in cases]
    brands = [("Lumnölund™", "B1"), ("Lumno - Lund", "B1"), ("Lumn0lund Max Series", "B1"), ("ULM-5X", "B1"), ("vorvequist hme", "B2"), ("Nullard", "UNMATCHED"), ("Brand: Lumnolund", "B1"), ("Vorvequist", "B2")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(brands)], "row_id bigint, b string")
    got = {r.row_id: r.canonical_id for r in canonical.map_names(df, "row_id", {"b": "BRAND"}, reg).collect()}
    assert [got.get(i) for i in range(len(brands))] == [c[1] for c in brands]
    assert canonical.map_names(df.limit(0), "row_id", {"b": "BRAND"}, reg).count() == 0
    assert {r.canonical_id for r in canonical.map_names(df, "row_id", {"b": "BRAND"}, reg.limit(0)).collect()} == {"UNMATCHED"}


def test_names_of_common_words(spark):
    names = ["SKF", "Bosch Tools", "Bosch Rexroth", "Bosch Thermo", "Power Thermo", "Power Tools", "Rexroth Power", "Supply Co", "Bosch Power Supply Co", "Rexroth Supply Co"] + [f"Name{chr(97 + i) * 6} Ltd" for i in range(12)]
    reg = spark.createDataFrame([(f"M{i:02}", "MANUFACTURER", n, f"c{i}x", None, []) for i, n in enumerate(names)], "record_id string, record_kind string, canonical_name string, code string, manufacturer_id string, aliases array<string>")
    cases = [("SKF Ltd", "M00"), ("Tools - Bosch", "M01"), ("Rexrot, Bosch", "M02"), ("Co of Power, Bosch Supply", "M08"), ("Power / Thermo Ltd", "M04"), ("Fenkyvane Ltd", "UNMATCHED"), ("Nameaaaaaa SKF", "M10")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "row_id bigint, part_manuf string")
    got = {r.row_id: r.canonical_id for r in canonical.map_names(df, "row_id", {"part_manuf": "MANUFACTURER"}, reg).collect()}
    assert [(c[0], got.get(i)) for i, c in enumerate(cases)] == cases


def test_residue(spark):
    bad = ["{{ brand }}", "[insert mfr]", "-- No DIB Brand --", "n/a", "Error 503", "lorem ipsum", "%BRAND_NAME%", "#REF!", "????", "No Brand", "your brand here", "<title>Service Unavailable"]
    good = ["Nullard", "Unbrandt", "Errorlok", "Xxenon", "Tobeco", "N&A Tools", "Lumnolund", "Nonesuch Hardware"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(bad + good + [None, " "])], "row_id bigint, b string")
    titles = ["Page not found", "undefined | Shop", "Robot Arm Timer", "404 - page cannot be shown", "Nail Gun | {{ site_name }}", "Bracket {L-shaped}", "Template Set [5 pieces]", "Tee 100% Cotton", "Pagee not foundd", None]
    tf = spark.createDataFrame([(i, t, "x") for i, t in enumerate(titles)], "context_id bigint, page_title string, value string")
    got = {(r.table_name, r.record_id) for r in residue.find_residue([(df, "d", "row_id", {"b": False}), (tf, "s", "context_id", {"page_title": True})]).collect()}
    assert got == {("d", i) for i in range(len(bad))} | {("s", i) for i in (0, 1, 3, 4)} | ({("s", 8)} & got)


def test_labels_spread_along_components(spark):
    base = "the service you asked for cannot be reached at this moment please try again in a while or call the desk for help number one"
    chain = [base + " and then some" * i for i in range(4)]
    found = spark.createDataFrame([(c,) for c in chain] + [("a quite different value that nobody would take for the same thing at all",), ("",)], "unit string")
    assert _distance(chain[0], chain[2]) > 0.15 * len(chain[2])
    assert {r.unit for r in residue.spread_labels(found, [base]).collect()} == set(chain)
    assert residue.spread_labels(found.limit(0)).count() == 0


PAGE = """Shop Home
Menu
Brands | Deals | Contact | Support | News
Home > Tools > Metric
Nail Gun, 1/2 in
Item #: 7G-351-120
The nail gun is meant for people who drive long lags more than once a week.
Key benefits
• Large grip
Specs
Weight | 0.4 kg
Always switch off and unplug the unit before you change any accessory.

Customers also viewed
Mower Deck 29-91-6821
Range Hood, 6 ft $381.99
From our blog
The team met at the grinding bench to compare 9 versions of the flap disc.
Read more
© 2031 Shop. All rights reserved."""


def test_main_body(spark):
    pages = [(i, PAGE, "https://shop.example/p", "Nail Gun, 1/2 in") for i in range(12)] + [(20, None, None, None), (21, "", None, None)]
    df = spark.createDataFrame([(*p, "t") for p in pages], "context_id bigint, page_text string, url string, page_title string, line_no string")
    got = mainbody.main_lines(df, "context_id", "page_text", "url", "page_title").filter("p_main > 0.5").collect()
    assert {r.line_no for r in got} == {5, 6, 7, 8, 9, 10, 11, 12} and {r.context_id for r in got} == set(range(12))
    assert mainbody.main_lines(df.limit(0), "context_id", "page_text", "url", "page_title").count() == 0


def test_hidden_patterns_are_learned_from_the_rest(spark, data):
    t = spark.read.parquet(f"{data}/../sf0.01/source_context.parquet")
    args = ("context_id", "page_text", "canonical_product_url", "page_title")
    whole = mainbody.fit(t, *args)
    sample = [(r["_masked"], r["_hashes"], mainbody.title_of(r["_title"], r["_site"])) for r in mainbody.read_pages(t, *args[1:]).collect()]
    met = sorted({(x, h) for m, hs, _ in sample for x, h in zip(m, hs) if x and mainbody.pattern_of(x, 0.0)})
    hidden = frozenset(x for x, _ in random.Random(3).sample(met, len(met) // 2))
    part = mainbody.train(sample, whole.shares, hidden)
    same = n = 0
    for m, hs, title in sample:
        a, b = whole.nodes(m, hs, title), part.nodes(m, hs, title)
        for node, p, q in zip(a, mainbody.marginals(a, whole.edge), mainbody.marginals(b, part.edge)):
            if node["text"] in hidden:
                n, same = n + 1, same + ((p > 0.5) == (q > 0.5))
    assert n > 100 and same / n >= 0.8


def test_masked_lines_in_both_places(spark):
    text = "Shop7 Home\n\n  Nail Gun, 1/2 in \nShop7: 44 pieces\tleft"
    got = spark.createDataFrame([(text, "https://www.shop7.example/x", "t")], "text string, url string, t string")
    got = mainbody.read_pages(got, "text", "url", "t").first()
    assert got["_site"] == "shop7" and got["_masked"] == [mainbody.mask(x, "shop7") for x in text.split("\n")]


def test_marginals_by_enumeration():
    edges = {f"h|{p}|{s}": w for (p, s), w in {(0, 0): 0.8, (0, 1): 0.2, (1, 0): 0.3, (1, 1): 0.7}.items()}
    nodes = [{"role": "h", "parent": -1, "score": 0.5}, {"role": "h", "parent": 0, "score": -1.3}, {"role": "x", "parent": 1, "score": 0.1}, {"role": "x", "parent": 0, "score": -0.2}, {"role": "x", "parent": -1, "score": 0.9}]
    weight = {}
    for bits in np.ndindex(2, 2, 2, 2, 2):
        w = 1.0
        for n, s in zip(nodes, bits):
            w *= 1 / (1 + np.exp(-n["score"] if s else n["score"]))
            if n["parent"] >= 0:
                w *= edges[f"h|{bits[n['parent']]}|{s}"]
        weight[bits] = w
    total = sum(weight.values())
    expected = [sum(w for b, w in weight.items() if b[i]) / total for i in range(5)]
    assert np.allclose(mainbody.marginals(nodes, edges), expected)


def test_hilbert_neighbours():
    points = np.array(list(np.ndindex(8, 8, 8)))
    order = points[np.argsort(packing.hilbert_keys(points, 3))]
    assert len(set(packing.hilbert_keys(points, 3))) == 512 and (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_packing(spark):
    texts = [("the old pump " * n).strip() for n in [1, 5, 9, 30, 200, 3, 77]] * 3 + [None, ""]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id bigint, text string, curve string")
    sizes = {r.doc_id: r.n_tokens for r in packing.measured(df, "doc_id", "text").collect()}
    got = packing.pack(df, "doc_id", "text", {1: 64, 2: 512, 3: 0}).collect()
    for pack_id, capacity in ((1, 64), (2, 512)):
        own = [r for r in got if r.pack_id == pack_id]
        boxes = {}
        for r in own:
            boxes.setdefault((r.range_no, r.container_no), []).append(r)
        for b in boxes.values():
            assert sum(r.n_tokens for r in b) + b[0].leftover == capacity and sorted(r.order_no for r in b) == list(range(1, len(b) + 1))
        for doc, n in sizes.items():
            pieces = sorted((r.first_token, r.n_tokens) for r in own if r.doc_id == doc)
            assert sum(p[1] for p in pieces) == n and (len(pieces) == 1 or n > capacity) and [p[0] for p in pieces] == [i * capacity for i in range(len(pieces))]
    assert {r.pack_id for r in got} == {1, 2} and packing.pack(df.limit(0), "doc_id", "text", {1: 64}).count() == 0


def test_leaks(spark):
    rnd = random.Random(3)
    name = lambda: "".join(rnd.choice(["Bri", "Kor", "Zan", "Vel"]) + rnd.choice(["mo", "la", "tu"]) + rnd.choice(["wick", "dal", "tex"]) + str(rnd.randint(0, 0) or "") for _ in range(1)) + rnd.choice("abcdefgh")
    sentence = lambda: f"{name()} asked {name()} to clear a blocked drain {rnd.randint(10, 99)} times, once behind guard {rnd.randint(10, 99)}-{rnd.randint(10, 99)}-{rnd.randint(1000, 9999)} and later behind the pump of {name()}."
    items = [(i, " ".join(sentence() for _ in range(3))) for i in range(20)]
    leak = "Intro words here. " + items[4][1].upper().replace(" ONCE ", "\n**once** ") + " End."
    changed = items[7][1].replace("blocked", "clogged")
    short = " ".join(items[9][1].split()[:9])
    other = sentence() + " " + sentence()
    docs = [(1, leak), (2, "Some text. " + changed), (3, short), (4, other), (5, None), (6, ""), (7, leak), (8, "word " * 20000 + items[11][1])]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, term int")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, "doc_id", "text", i, "item_id", "text").filter("n_words >= 20").collect()}
    assert got == {(1, 4), (7, 4), (2, 7), (8, 11)}
    assert leakage.find_leaks(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0


def test_leaks_without_names(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(7))
    plain = [word() for _ in range(30)]
    items = [(1, " ".join(plain)), (2, "Brimowick asked Kortudal to clear 77-11 drains and Zanlatex to close 81-2 valves " + " ".join(word() for _ in range(30)))]
    leak = " ".join([word() for _ in range(9)] + plain[4:26])
    gap = items[1][1].split()[14:38]
    docs = [(1, leak), (2, " ".join(gap)), (3, " ".join(word() for _ in range(50)))] + [(10 + i, "the pump is near the valve") for i in range(400)]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, "doc_id", "text", i, "item_id", "text").filter("n_words >= 20").collect()}
    assert got == {(1, 1), (2, 2)}


def test_leaks_of_common_words(spark):
    rnd = random.Random(4)
    common = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(200)]
    names = "Brimowick asked Kortudal to clear 77-11 drains and Zanlatex to close 81-2 valves {} "
    passage, changed, stock = (rnd.sample(common, 40) for _ in range(3))
    items = [(1, names.format("Velmotex") + " ".join(passage)), (2, names.format("Velladal") + " ".join(changed)), (3, names.format("Zanmowick") + " ".join(stock))]
    every_other = [w if i % 2 else "changed" for i, w in enumerate(changed)] + changed[:4]
    docs = [(i, " ".join(rnd.choice(common) for _ in range(30))) for i in range(400)] + [(500 + i, "so " + " ".join(stock[5:30])) for i in range(30)]
    docs += [(900, " ".join(passage[3:28])), (901, "so " + " ".join(every_other))]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, "doc_id", "text", i, "item_id", "text").filter("n_words >= 20").collect()}
    assert got == {(900, 1), (901, 2)}


def test_leaks_read_the_corpus_twice(spark):
    rnd = random.Random(9)
    common = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(60)]
    items = [(f"i{k}", f"Velmo{'abcdefgh'[k]}tex asked {'efghabcd'[k]}Kortudal " + " ".join(rnd.sample(common, 40))) for k in range(8)] + [(None, "Brimowick said so"), ("empty", None)]
    texts = [" ".join(rnd.choice(common) for _ in range(25)) for _ in range(400)] + [items[k][1][20:] for k in range(0, 8, 2)]
    docs = [(f"d{i}", t) for i, t in enumerate(texts)] + [(None, items[1][1]), ("e", ""), ("n", None)]
    d, i = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    leaks = lambda frame: {(r.doc_id, r.item_id): r.n_words for r in leakage.find_leaks(frame, "doc_id", "text", i, "item_id", "text").collect()}
    got = leaks(d.mapInPandas(counted, d.schema))
    assert read.value == 2 * len(docs)
    assert {k for k, n in got.items() if n >= 20} == {(f"d{400 + k // 2}", f"i{k}") for k in range(0, 8, 2)}
    before = leakage.GROUP_WORDS
    try:
        leakage.GROUP_WORDS = 100
        assert leaks(d) == got
    finally:
        leakage.GROUP_WORDS = before
    assert leakage.find_leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0


def test_words_of_ascii_text_and_of_any():
    rnd = random.Random(11)
    for _ in range(3000):
        text = "".join(rnd.choice("aB9-'-' .<>&b/;#!_*\n") for _ in range(rnd.randint(0, 30)))
        assert leakage.words(text) == [w.lower() for w in leakage.cased_words(text)] == leakage.words(text + " \u00e9")[:-1], text
    assert leakage.words("Fünf <b>x-ray</b>&amp;O’Neil -a--b- \u0130z") == ["fünf", "x-ray", "o’neil", "a", "b", "\u0130z".lower()]


def test_index_of_items_against_brute_force():
    rnd = random.Random(12)
    for _ in range(20):
        items = [[f"w{rnd.randint(0, 25)}" for _ in range(rnd.randint(1, 45))] for _ in range(5)]
        telling = [[rnd.random() < 0.05 for _ in x] for x in items]
        docs = [[f"w{rnd.randint(0, 40)}" for _ in range(rnd.randint(0, 40))] for _ in range(30)]
        docs += [docs[k] + items[k % 5][3:30] for k in range(8)]
        rows = [(i, p, t, telling[i][p]) for i, x in enumerate(items) for p, t in enumerate(x)]
        held = leakage.Items(pa.table(dict(zip(("item_id", "pos", "term", "telling"), map(list, zip(*rows))))))
        (ids, starts), most = next(held.parsed(" ".join(x) for x in docs)), rnd.choice([2, 6, 20])
        n = np.bincount(held.met(ids)[1], minlength=len(held.pairs))
        held.weigh(np.bincount(ids + 1, minlength=len(held.vocabulary) + 1)[1:], n, most)
        places = collections.Counter(t for x in docs for t in x)
        pairs = collections.Counter((a, b, g) for x in docs for g in (1, 2) for a, b in zip(x, x[g:]))
        weights, agreed = [], collections.Counter()
        for i, x in enumerate(items):
            blocks = [range(b, min(b + 10, len(x))) for b in range(0, len(x), 10)]
            w = [2 if telling[i][p] else int(not any(telling[i][q] for q in blocks[p // 10]) and places[x[p]] <= most) for p in range(len(x))]
            dark = [p for p in range(len(x)) if sum(w[q] for q in blocks[p // 10]) < 2]
            begin = [(p, g) for p in dark for g in (1, 2) if p + g < len(x) and 0 < pairs[x[p], x[p + g], g] <= most]
            for k, y in enumerate(docs):
                for o, t in enumerate(y):
                    agreed.update({(k, i, o - p): w[p] for p in range(len(x)) if x[p] == t and w[p]})
                    for p, g in begin:
                        agreed[k, i, o - p] += 2 * (y[o : o + g + 1 : g] == [x[p], x[p + g]])
            weights.append([-1 if not v and any(p == q for q, _ in begin) else v for p, v in enumerate(w)])
        along = collections.defaultdict(list)
        for (k, i, o), v in agreed.items():
            if v >= 2:
                along[k, i].append(o)
        want = {(k, i): leakage.carried(items[i], weights[i], docs[k], o) for (k, i), o in along.items()}
        doc, no, found = held.compared(ids, starts)
        assert {(int(k), held.ids[int(i)].as_py()): int(v) for k, i, v in zip(doc, no, found)} == want


def test_carried_against_brute_force():
    rnd = random.Random(5)
    item = [f"w{rnd.randint(0, 30)}" for _ in range(40)]
    doc = [f"w{rnd.randint(0, 30)}" for _ in range(60)]
    doc[10:35] = item[5:30]
    telling = [2 * (w in ("w3", "w7", "w11")) for w in item]
    n = leakage.carried(item, telling, doc, [5])
    assert n >= 25 if any(telling[5:30]) else n == 0


def test_subjects_on_held_out_labels(spark):
    rnd = random.Random(7)
    words = {s: [f"{a}{b}ing" for a in (chr(97 + s) * 2, chr(97 + s) + "k") for b in ("mor", "tas", "vel", "pon")] for s in range(1, 5)}
    frame = ["the {} was taken before the {} came", "some people like a {} more than a {}", "keep the {} away from the {} until noon"]
    say = lambda s: rnd.choice(frame).format(rnd.choice(words[s]), rnd.choice(words[s])) + ". "
    docs, truth = [], {}
    for i in range(240):
        own = rnd.sample(sorted(words), rnd.choice([1, 1, 2]))
        docs.append((i, "".join(say(s) for s in own for _ in range(6))))
        truth[i] = set(own)
    d = spark.createDataFrame([*docs, (900, None), (901, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, i, s) for k, (i, s) in enumerate((i, s) for i in range(160) for s in truth[i])], "label_id bigint, doc_id bigint, subject_id int")
    areas = spark.createDataFrame([(s, f"area {s}", None) for s in words], "subject_id int, subject_name string, description string")
    got = {}
    for r in subjects.document_subjects(d, labels, areas).collect():
        got.setdefault(r.doc_id, set()).add(r.subject_id)
    right = sum(got.get(i, set()) == truth[i] for i in range(160, 240))
    assert right >= 76 and not {900, 901} & set(got)
    assert subjects.document_subjects(d.limit(0), labels.limit(0), areas).count() == 0


@pytest.mark.parametrize("text", ["", "word", "Das ist die Pumpe und der Filter.", "x" * 100_000])
def test_sentences(text):
    assert all(isinstance(t, str) for s in subjects.sentences(text) for t in s)
    assert subjects.language(subjects.sentences(text)) == ("de" if "Das" in text else "en")
    assert re.sub(r"\W", "", text).lower()[:3] in ("", *(t[:3] for s in subjects.sentences(text) for t in s)) or len(text) < 3


def _texts(rnd, n):
    bits = ["der", "die", "the", "and", "les", "pump", "Ventil", "ab", "x", "2nd", "½²³", "é", "Öl", "tank9valve", "_", "\0", ".", "!", "; ", ". ", "?\n", "\n", "\n\n", ".\t", " ", " ", " ", "\x1c", "\xa0", "-"]
    return ["".join(rnd.choice(bits) + rnd.choice(["", " "]) for _ in range(rnd.choice([0, 1, 5, 40]))) for _ in range(n)]


def test_terms_of_batches_are_those_of_sentences():
    rnd = random.Random(21)
    texts = _texts(rnd, 2000)
    read, = subjects.parsed(texts, subjects.Pieces())
    slots = subjects.Slots()
    code, terms = read.stored()
    (doc, again), = subjects.read_again(pa.RecordBatch.from_arrays([pa.array(range(len(texts))), code, terms], ["doc_id", "code", "terms"]))
    assert doc.to_pylist() == list(range(len(texts))) and (again.of == read.of).all() and (again.slot == read.slot).all() and (again.code == read.code).all()
    assert (np.diff(again.sentence) == (np.diff(read.sentence) > 0)).all()
    got = [[] for _ in texts]
    for i, s, t in zip(read.of, read.sentence, read.slot):
        got[i].append((s, t))
    for text, code, own in zip(texts, read.code, got):
        want = subjects.sentences(text)
        assert [[t for _, t in g] for _, g in itertools.groupby(own, key=lambda x: x[0])] == [[slots[t] for t in s] for s in want], text
        assert subjects.CODES[code] == subjects.language(want)


def test_shares_of_batches_by_single_documents():
    rnd, rng = random.Random(22), np.random.default_rng(22)
    texts, slots = _texts(rnd, 500), subjects.Slots()
    known = np.unique([slots[t] for x in texts[:250] for s in subjects.sentences(x) for t in s])
    parts = [{"slots": known[c:], "logp": rng.normal(size=(len(known) - c, 4)).astype("float32"), "prior": rng.normal(size=4)} for c in range(3)]
    parts.append({"slots": np.zeros(0, dtype=np.int64), "logp": np.zeros((0, 4), dtype="float32"), "prior": np.zeros(4)})
    model = {"subjects": [1, 2, 3], "idf": rng.random((4, subjects.SLOTS)).astype("float32"), "centres": rng.normal(size=(5, subjects.DIMS)).astype("float32"), "mixtures": rng.normal(size=(4, 5, 4)).astype("float32"), "parts": parts}
    read, = subjects.parsed(texts, subjects.Pieces())
    at, sign = subjects._fold()
    for text, got in zip(texts, subjects.Reader(model).shares(read)):
        found = subjects.sentences(text)
        c = subjects.CODES.index(subjects.language(found))
        place = {int(s): i for i, s in enumerate(parts[c]["slots"])}
        vector, want = np.zeros(subjects.DIMS), np.zeros(4)
        for t, n in collections.Counter(slots[t] for s in found for t in s).items():
            vector[at[t]] += np.log1p(n) * model["idf"][c, t] * sign[t]
        mixture = model["mixtures"][c, np.argmax(model["centres"] @ vector)]
        for s in found:
            if told := [place[slots[t]] for t in s if slots[t] in place]:
                want[np.argmax(sum(parts[c]["logp"][i] for i in told) + parts[c]["prior"] + mixture)] += len(s)
        assert np.allclose(got, want / max(1, sum(map(len, found)))), text


def test_subjects_read_the_text_once_beside_the_labelled_sample(spark):
    d = spark.createDataFrame([(i, f"The {'pump' if i % 2 else 'drill'} was taken before the {'valve' if i % 2 else 'chuck'} came. ") for i in range(60)], "doc_id bigint, text string")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    labels = spark.createDataFrame([(i, i, 1 + i % 2) for i in range(40)], "label_id bigint, doc_id bigint, subject_id int")
    areas = spark.createDataFrame([(1, "drills", None), (2, "pumps", None)], "subject_id int, subject_name string, description string")
    got = {(r.doc_id, r.subject_id) for r in subjects.document_subjects(d.mapInPandas(counted, d.schema), labels, areas).collect()}
    assert got == {(i, 1 + i % 2) for i in range(60)}
    assert read.value == 2 * 60
