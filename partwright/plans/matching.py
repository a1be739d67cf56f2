"""Named queries: matches between texts and references, slots, checks, ids and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partwright.functions import identifiers, numbers, text, urls
from partwright.operators import delivery, timeline
from partwright.plans.profiling import RAW, _COLLAPSE, _KEY, rows
from partwright.session import broadcast_if_small, join_values, table

# What a description says about a product's family, first match counts.
FAMILIES = [("fasteners", r"\b(screw|bolt|nut|washer|rivet|anchor)\b"), ("abrasives", r"\b(disc|belt|sponge|abrasive|wheel)\b"), ("power tools", r"\b(drill|saw|grinder|router|planer)\b"), ("plumbing", r"\b(valve|pump|faucet|drain|pipe)\b")]


def pages(spark, sf_dir):
    return table(spark, sf_dir, "source_context")


def J11_family(spark, sf_dir):
    d, out = F.lower("part_desc"), None
    for name, rx in FAMILIES:
        out = F.when(d.rlike(rx), name) if out is None else out.when(d.rlike(rx), name)
    return rows(spark, sf_dir).filter("part_desc is not null").select("row_id", out.alias("family"))


J11_SQL = "SELECT row_id, CASE " + " ".join(f"WHEN regexp_matches(lower(part_desc), '{rx}') THEN '{n}'" for n, rx in FAMILIES) + " END AS family FROM delivery_rows WHERE part_desc IS NOT NULL"


def J15_records_of_products(spark, sf_dir):
    """Golden records and pages of each product, as sorted id lists; products with neither do not show."""
    ids = lambda t, c, a: table(spark, sf_dir, t).groupBy("product_id").agg(F.array_join(F.array_sort(F.collect_set(c)).cast("array<string>"), ",").alias(a))
    return ids("expected_products", "record_id", "records").join(ids("source_context", "context_id", "contexts"), "product_id", "full")


J15_SQL = "SELECT coalesce(e.product_id, s.product_id) AS product_id, records, contexts FROM (SELECT product_id, array_to_string(list_sort(list(DISTINCT record_id)), ',') AS records FROM expected_products GROUP BY 1) e FULL JOIN (SELECT product_id, array_to_string(list_sort(list(DISTINCT context_id)), ',') AS contexts FROM source_context GROUP BY 1) s ON e.product_id = s.product_id"


def J21_mpn_in_description(spark, sf_dir):
    """Delivered part numbers that stand as a whole token in a description; an equality join on exploded tokens."""
    t = rows(spark, sf_dir).filter("part_desc is not null").select("row_id", F.explode(F.array_distinct(F.regexp_extract_all("part_desc", F.lit(r"[A-Za-z0-9][A-Za-z0-9._/-]*"), F.lit(0)))).alias("tok")).select("row_id", F.upper("tok").alias("k")).distinct()
    m = rows(spark, sf_dir).filter("length(mfg_part_num) >= 5").groupBy(F.upper("mfg_part_num").alias("k")).agg(F.min("product_id").alias("first_product"), F.count(F.lit(1)).alias("n"))
    return join_values(t, m, ["k"], "n", rows(spark, sf_dir).count()).select("row_id", "k", "first_product")


J21_SQL = "WITH t AS (SELECT DISTINCT row_id, upper(x) AS k FROM (SELECT row_id, unnest(regexp_extract_all(part_desc, '[A-Za-z0-9][A-Za-z0-9._/-]*')) AS x FROM delivery_rows WHERE part_desc IS NOT NULL)), m AS (SELECT upper(mfg_part_num) AS k, min(product_id) AS first_product FROM delivery_rows WHERE length(mfg_part_num) >= 5 GROUP BY 1) SELECT row_id, k, first_product FROM t JOIN m USING (k)"


def J22_candidate_urls(spark, sf_dir):
    """Addresses a product may have: each page's host with each of two templates and its part number."""
    templates = ["https://{host}/p/{mpn}", "https://{host}/search?q={mpn}"]
    p = pages(spark, sf_dir).select("context_id", urls.host(F.col("canonical_product_url")).alias("host"), F.trim("mpn").alias("mpn")).filter("host is not null and mpn != ''")
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("{host}"), F.col("host")), F.lit("{mpn}"), F.col("mpn"))
    return p.select("context_id", F.posexplode(F.array(*[fill(t) for t in templates])).alias("_p", "url")).select("context_id", (F.col("_p") + 1).alias("place"), "url")


J22_SQL = r"WITH p AS (SELECT context_id, nullif(regexp_replace(regexp_extract(lower(trim(canonical_product_url)), '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1), '\.$', ''), '') AS host, trim(mpn) AS mpn FROM source_context) SELECT context_id, place, CASE place WHEN 1 THEN 'https://' || host || '/p/' || mpn ELSE 'https://' || host || '/search?q=' || mpn END AS url FROM p, (VALUES (1), (2)) t(place) WHERE host IS NOT NULL AND mpn <> ''"


def X2_missing_attributes(spark, sf_dir):
    """Attributes that at least half of the golden records have and this record lacks."""
    e = table(spark, sf_dir, "expected_products")
    have = e.select("record_id", F.explode("expected_attributes").alias("a", "v")).filter("trim(v) != ''").select("record_id", "a").distinct()
    n = e.agg(F.countDistinct("record_id").alias("n"))
    common = have.groupBy("a").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(n)).filter("c * 2 >= n").agg(F.array_sort(F.collect_list("a")).alias("req"))
    own = e.select("record_id").join(have.groupBy("record_id").agg(F.collect_set("a").alias("own")), "record_id", "left").join(F.broadcast(common))
    gone = F.array_except("req", F.coalesce("own", F.array().cast("array<string>")))
    return own.filter(F.size(gone) > 0).select("record_id", F.array_join(F.array_sort(gone), ", ").alias("missing"))


X2_SQL = """
WITH h AS (SELECT DISTINCT record_id, a FROM (SELECT record_id, unnest(map_keys(expected_attributes)) AS a, unnest(map_values(expected_attributes)) AS v FROM expected_products) WHERE trim(v) <> ''),
c AS (SELECT a FROM h GROUP BY 1 HAVING count(*) * 2 >= (SELECT count(DISTINCT record_id) FROM expected_products))
SELECT record_id, string_agg(a, ', ' ORDER BY a) AS missing FROM expected_products, c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.record_id = expected_products.record_id AND h.a = c.a) GROUP BY 1
"""


def W5_image_roles(spark, sf_dir):
    """Images in order, the first as primary, up to ten."""
    u = delivery.ordered_urls(pages(spark, sf_dir), "context_id", ["image_urls"]).filter("place <= 10")
    return u.select("context_id", "url", F.when(F.col("place") == 1, "PRIMARY").otherwise(F.concat(F.lit("ALTERNATE_"), F.col("place") - 1)).alias("role"))


W5_SQL = "WITH u AS (SELECT context_id, unnest(image_urls) AS url, generate_subscripts(image_urls, 1) AS o FROM source_context), f AS (SELECT context_id, url, row_number() OVER (PARTITION BY context_id ORDER BY min(o)) AS p FROM u WHERE url IS NOT NULL GROUP BY 1, 2) SELECT context_id, url, CASE WHEN p = 1 THEN 'PRIMARY' ELSE 'ALTERNATE_' || (p - 1) END AS role FROM f WHERE p <= 10"


def T8_spec_line(spark, sf_dir):
    """The attributes of a record as one line of up to 60 characters, whole attributes only while they fit."""
    parts = F.transform(F.filter(F.array_sort(F.map_entries("expected_attributes")), lambda a: F.trim(a["value"]) != ""), lambda a: F.concat(a["key"], F.lit(": "), F.trim(a["value"])))
    return table(spark, sf_dir, "expected_products").select("record_id", text.truncate_words(parts, 60).alias("line"))


T8_SQL = """
WITH p AS (SELECT record_id, list_transform(list_filter(list_sort(map_entries(expected_attributes)), lambda e: trim(e.value) <> ''), lambda e: e.key || ': ' || trim(e.value)) AS p FROM expected_products)
SELECT record_id, CASE WHEN p IS NULL THEN NULL WHEN len(p) = 0 THEN '' ELSE rtrim(substring(list_reduce(p, lambda a, x: CASE WHEN length(a) + length(x) + 2 <= 60 THEN a || ', ' || x ELSE a END), 1, 60)) END AS line FROM p
"""


def C8_code_tokens(spark, sf_dir):
    """Whether a description holds its part number as a token of its own."""
    d, m = F.upper("part_desc"), F.upper(F.trim("mfg_part_num"))
    toks = F.regexp_extract_all(d, F.lit("[A-Z0-9][A-Z0-9._/-]*"), F.lit(0))
    return rows(spark, sf_dir).filter("part_desc is not null and trim(mfg_part_num) != ''").select("row_id", F.array_contains(toks, m).alias("has_code"))


C8_SQL = "SELECT row_id, list_contains(regexp_extract_all(upper(part_desc), '[A-Z0-9][A-Z0-9._/-]*'), upper(trim(mfg_part_num))) AS has_code FROM delivery_rows WHERE part_desc IS NOT NULL AND trim(mfg_part_num) <> ''"


def C15_features(spark, sf_dir):
    """Feature lines of pages: bullets removed, 5 to 250 characters, no addresses, each once per page."""
    lines = pages(spark, sf_dir).filter("page_text is not null").select("context_id", F.explode(F.split("page_text", "\n")).alias("l"))
    clean = text.collapse(F.regexp_replace("l", r"^\s*[-*•·]\s+", ""))
    kept = lines.filter(F.col("l").rlike(r"^\s*[-*•·]\s+\S")).select("context_id", clean.alias("feature")).filter((F.length("feature") >= 5) & (F.length("feature") <= 250) & ~F.lower("feature").rlike("https?://|www\\."))
    return kept.groupBy("context_id", F.lower("feature").alias("feature")).agg(F.count(F.lit(1)).alias("times"))


C15_SQL = rf"WITH l AS (SELECT context_id, unnest(string_split(page_text, chr(10))) AS l FROM source_context WHERE page_text IS NOT NULL), f AS (SELECT context_id, {_COLLAPSE.format(c=chr(114) + 'egexp_replace(l, ' + chr(39) + '^' + chr(92) + 's*[-*•·]' + chr(92) + 's+' + chr(39) + ', ' + chr(39) * 2 + ')')} AS f FROM l WHERE regexp_matches(l, '^\s*[-*•·]\s+\S')) SELECT context_id, lower(f) AS feature, count(*) AS times FROM f WHERE length(f) BETWEEN 5 AND 250 AND NOT regexp_matches(lower(f), 'https?://|www\.') GROUP BY 1, 2"


def C19_description_checks(spark, sf_dir):
    """What is wrong with composed descriptions: one row per rule broken."""
    d = rows(spark, sf_dir)
    rules = F.array_compact(
        F.array(
            F.when(F.length("invoice_desc") > 100, "invoice_too_long"), F.when(F.col("invoice_desc") != F.upper("invoice_desc"), "invoice_not_upper"), F.when(~F.contains(F.upper("mobile_desc"), F.upper("mfg_part_num")), "mobile_without_code"),
            F.when(F.contains("mobile_desc", F.lit("-- ")), "placeholder_leaked"),
        )
    )
    return d.select("row_id", F.explode(rules).alias("rule"))


C19_SQL = "SELECT row_id, 'invoice_too_long' AS rule FROM delivery_rows WHERE length(invoice_desc) > 100 UNION ALL SELECT row_id, 'invoice_not_upper' FROM delivery_rows WHERE invoice_desc <> upper(invoice_desc) UNION ALL SELECT row_id, 'mobile_without_code' FROM delivery_rows WHERE NOT contains(upper(mobile_desc), upper(mfg_part_num)) UNION ALL SELECT row_id, 'placeholder_leaked' FROM delivery_rows WHERE contains(mobile_desc, '-- ')"


def M3_fraction_table(spark, sf_dir):
    """Decimal sizes of golden records that a table of sixty-fourths gives as a fraction."""
    table64 = spark.range(1, 64).select(F.round(F.col("id") / 64, 4).alias("d"), numbers.double_to_fraction(F.col("id") / 64).alias("fraction"))
    e = table(spark, sf_dir, "expected_products").select("record_id", F.explode("expected_attributes").alias("attribute_name", "raw"))
    n = F.regexp_extract("raw", r"^(0?\.[0-9]+) ?(?:in|inch|inches|\")?$", 1)
    return e.select("record_id", "attribute_name", F.round(F.nullif(n, F.lit("")).cast("double"), 4).alias("d")).filter("d is not null").join(F.broadcast(table64), "d").select("record_id", "attribute_name", "fraction")


M3_SQL = r"""
WITH t AS (SELECT round(n / 64.0, 4) AS d, (n // gcd(n, 64)) || '/' || (64 // gcd(n, 64)) AS fraction FROM range(1, 64) r(n)),
e AS (SELECT record_id, unnest(map_keys(expected_attributes)) AS attribute_name, unnest(map_values(expected_attributes)) AS raw FROM expected_products),
x AS (SELECT record_id, attribute_name, round(TRY_CAST(regexp_extract(raw, '^(0?\.[0-9]+) ?(?:in|inch|inches|")?$', 1) AS DOUBLE), 4) AS d FROM e)
SELECT record_id, attribute_name, fraction FROM x JOIN t USING (d)
"""


def M4_identity_score(spark, sf_dir):
    """How well a page fits a delivered product: part number, maker, and words of the description in the title."""
    d = rows(spark, sf_dir).groupBy("product_id").agg(F.min(F.struct("row_id", "mfg_part_num", "part_manuf", "part_desc", "e1_brand")).alias("d"))
    j = pages(spark, sf_dir).select("context_id", "product_id", "mpn", "manufacturer", "brand", "page_title").join(d, "product_id")
    same = text.mpn_match(F.col("mpn"), F.col("d.mfg_part_num")).isin("EXACT", "NORMALIZED_EQUIVALENT")
    maker = F.coalesce(text.canonical_key(F.col("manufacturer")) == text.canonical_key(text.without_code(F.col("d.part_manuf"))), F.lit(False))
    brand = F.coalesce(text.canonical_key(F.col("brand")) == text.canonical_key(F.col("d.e1_brand")), F.lit(False))
    title = F.coalesce(F.contains(F.lower("page_title"), F.lower(F.trim("mpn"))), F.lit(False))
    words = F.when(F.col("page_title").isNotNull() & F.col("d.part_desc").isNotNull(), text.overlap_share(F.col("d.part_desc"), F.col("page_title"))).otherwise(0.0)
    score = sum((F.when(c, w).otherwise(0.0) for w, c in ((0.5, same), (0.2, maker | brand), (0.1, maker & brand), (0.1, title), (0.1, words >= 0.15))), F.lit(0.0))
    context = maker | brand | title | (words >= 0.15)
    capped = F.when(same & ~context, F.least(score, F.lit(0.55))).otherwise(score)
    verdict = F.when(same & context & (score >= 0.8), "EXACT_MATCH").when(same & context & (score >= 0.6), "STRONG_MATCH").when(same | (score >= 0.35), "WEAK_MATCH").otherwise("MISMATCH")
    return j.select("context_id", F.bround(capped, 3).alias("score"), verdict.alias("classification"))


_LETTERS = r"regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_NAMED = r"regexp_replace(d.part_manuf, '\s*\([A-Za-z0-9-]+\)\s*$', '')"
M4_SQL = rf"""
WITH d AS (SELECT * FROM delivery_rows QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY row_id) = 1),
j AS (SELECT context_id, coalesce({_LETTERS.format(c='s.mpn')} = {_LETTERS.format(c='d.mfg_part_num')} AND {_LETTERS.format(c='s.mpn')} <> '', FALSE) AS same,
 coalesce({_KEY.format(c='s.manufacturer')} = {_KEY.format(c=_NAMED)}, FALSE) AS maker, coalesce({_KEY.format(c='s.brand')} = {_KEY.format(c='d.e1_brand')}, FALSE) AS brand,
 coalesce(contains(lower(page_title), lower(trim(s.mpn))), FALSE) AS title, lower(page_title) AS t, list_distinct(list_filter(string_split({_KEY.format(c='d.part_desc')}, ' '), lambda w: length(w) >= 4)) AS w FROM source_context s JOIN d USING (product_id)),
o AS (SELECT *, coalesce(CASE WHEN t IS NOT NULL AND len(w) > 0 THEN len(list_filter(w, lambda x: contains(t, x))) / len(w) END, 0) >= 0.15 AS overlap FROM j),
c AS (SELECT *, CASE WHEN same THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN maker OR brand THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN maker AND brand THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN title THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN overlap THEN 0.1::DOUBLE ELSE 0 END AS score, maker OR brand OR title OR overlap AS context FROM o)
SELECT context_id, round_even(CASE WHEN same AND NOT context THEN least(score, 0.55) ELSE score END, 3)::DOUBLE AS score,
 CASE WHEN same AND context AND score >= 0.8 THEN 'EXACT_MATCH' WHEN same AND context AND score >= 0.6 THEN 'STRONG_MATCH' WHEN same OR score >= 0.35 THEN 'WEAK_MATCH' ELSE 'MISMATCH' END AS classification FROM c
"""


def M7_running_budget(spark, sf_dir):
    """The running total of each user's events and whether it still lies within a budget."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    run = timeline.running_sum(e, "user_id", "ts", "event_id", F.round("value", 2).cast("decimal(18,2)"))
    return run.select("event_id", F.col("running").cast("double").alias("spent"), (F.col("running") <= 500).alias("within"))


M7_SQL = "SELECT event_id, CAST(s AS DOUBLE) AS spent, s <= 500 AS within FROM (SELECT event_id, sum(CAST(round(value, 2) AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events)"


def X9_known_hosts(spark, sf_dir):
    """Hosts of pages and of delivered maker addresses, with where they are known from."""
    a = pages(spark, sf_dir).select(urls.host(F.col("canonical_product_url")).alias("host"), F.lit("page").alias("via"))
    b = rows(spark, sf_dir).select(urls.host(F.col("mfr_url")).alias("host"), F.lit("delivery").alias("via"))
    return a.unionByName(b).filter("host is not null").groupBy("host").agg(F.array_join(F.array_sort(F.collect_set("via")), "+").alias("known_from"), F.count(F.lit(1)).alias("n"))


X9_SQL = r"WITH h AS (SELECT regexp_extract(lower(trim(canonical_product_url)), '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1) AS host, 'page' AS via FROM source_context UNION ALL SELECT regexp_extract(lower(trim(mfr_url)), '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1), 'delivery' FROM delivery_rows) SELECT regexp_replace(host, '\.$', '') AS host, array_to_string(list_sort(list(DISTINCT via)), '+') AS known_from, count(*) AS n FROM h WHERE host <> '' GROUP BY 1"


def F14_private_hosts(spark, sf_dir):
    """Delivered maker addresses with whether they are refused: other schemes, no host, or a host of a private network."""
    u = F.col("mfr_url")
    return rows(spark, sf_dir).filter(u.isNotNull()).select("row_id", urls.canonical(u).isNull().alias("refused"))


F14_SQL = r"""
WITH u AS (SELECT row_id, lower(trim(mfr_url)) AS u, regexp_replace(regexp_extract(lower(trim(mfr_url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '\.$', '') AS h FROM delivery_rows WHERE mfr_url IS NOT NULL)
SELECT row_id, NOT regexp_matches(u, '^https?://') OR h = '' OR regexp_matches(h, '^(localhost|127\.\d+\.\d+\.\d+|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+|169\.254\.\d+\.\d+|172\.(1[6-9]|2\d|3[01])\.\d+\.\d+|0\.0\.0\.0|\[?::1\]?)$') AS refused FROM u
"""


def P4_attribute_payload(spark, sf_dir):
    """Each golden record as one JSON text: the map of attribute to value in order of the names, and its page captures with the values that their text quotes."""
    return payloads(table(spark, sf_dir, "expected_products"), pages(spark, sf_dir))


def payloads(products, captures):
    maker = F.struct(F.lit("Manufacturer").alias("key"), F.col("manufacturer").alias("value"))
    named = F.when(F.col("manufacturer").isNotNull() & ~F.exists("_e", lambda e: e["key"] == "Manufacturer"), F.array(maker)).otherwise(F.array())
    given = F.filter(F.coalesce(F.map_entries("expected_attributes"), F.array()), lambda e: e["value"].isNotNull())
    e = products.select("record_id", "product_id", "mpn", "manufacturer", given.alias("_e"))
    e = e.select("record_id", "product_id", "mpn", F.array_sort(F.concat("_e", named)).alias("_e"))
    s = captures.filter("canonical_product_url is not null").select("product_id", "context_id", "canonical_product_url", "source_type", "source_authority", "page_text")
    quoted = F.transform(F.filter("_e", lambda x: x["value"].rlike(r"\S") & F.coalesce(F.contains("page_text", x["value"]), F.lit(False))), lambda x: x["value"])
    source = F.struct("context_id", F.col("canonical_product_url").alias("url"), F.col("source_type").alias("type"), F.col("source_authority").alias("authority"), quoted.alias("evidence"))
    of = e.select("record_id", "product_id", "_e").join(s, "product_id").select("record_id", source.alias("s")).groupBy("record_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    body = F.struct("record_id", "product_id", "mpn", F.map_from_entries("_e").alias("product"), F.transform(F.coalesce("s", F.array()), lambda x: x.dropFields("context_id")).alias("sources"))
    return e.join(of, "record_id", "left").select("record_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


P4_ATTRIBUTE_SQL = r"""
WITH g AS (SELECT record_id, product_id, mpn, manufacturer, list_filter(coalesce(map_entries(expected_attributes), []), lambda e: e.value IS NOT NULL) AS a FROM expected_products),
e AS (SELECT record_id, product_id, mpn, list_sort(CASE WHEN manufacturer IS NULL OR list_contains(list_transform(a, lambda x: x.key), 'Manufacturer') THEN a ELSE list_append(a, {'key': 'Manufacturer', 'value': manufacturer}) END) AS a FROM g),
s AS (SELECT record_id, context_id, to_json({'url': canonical_product_url, 'type': source_type, 'authority': source_authority,
  'evidence': list_transform(list_filter(a, lambda x: regexp_matches(x.value, '\S') AND coalesce(contains(page_text, x.value), FALSE)), lambda x: x.value)})::VARCHAR AS j
 FROM e JOIN source_context USING (product_id) WHERE canonical_product_url IS NOT NULL),
l AS (SELECT record_id, string_agg(j, ',' ORDER BY context_id) AS j FROM s GROUP BY 1)
SELECT e.record_id, '{"record_id":' || e.record_id || ',"product_id":' || coalesce(to_json(product_id)::VARCHAR, 'null') || ',"mpn":' || coalesce(to_json(mpn)::VARCHAR, 'null') || ',"product":{' ||
 array_to_string(list_transform(a, lambda x: to_json(x.key)::VARCHAR || ':' || to_json(x.value)::VARCHAR), ',') || '},"sources":[' || coalesce(l.j, '') || ']}' AS payload
FROM e LEFT JOIN l USING (record_id)
"""


def P10_snapshot(spark, sf_dir):
    """Which raw fields of a row hold placeholders, and how many hold a value."""
    names = F.array_compact(F.array(*[F.when(text.strip(F.col(c)).isin(text.PLACEHOLDERS), F.lit(c)) for c in RAW]))
    n = sum((text.normalized(F.col(c))["normalized"].isNotNull().cast("bigint") for c in RAW), F.lit(0).cast("bigint"))
    return rows(spark, sf_dir).select("row_id", F.array_join(names, ",").alias("placeholders"), n.alias("n_values"))


_P = "('-- Unbranded --', '-- No Unilog Brand --', '-- No DIB Brand --')"
_S = [f"regexp_replace({c}, '^[\\s ]+|[\\s ]+$', '', 'g')" for c in RAW]
P10_SQL = "SELECT row_id, concat_ws(',', " + ", ".join(f"CASE WHEN {s} IN {_P} THEN '{c}' END" for c, s in zip(RAW, _S)) + ") AS placeholders, " + " + ".join(f"CAST(coalesce({s} <> '' AND {s} NOT IN {_P}, FALSE) AS BIGINT)" for s in _S) + " AS n_values FROM delivery_rows"


def K7_stable_ids(spark, sf_dir):
    e = table(spark, sf_dir, "expected_products").select("record_id", F.explode(F.map_keys("expected_attributes")).alias("attribute_name"), "product_id")
    return e.select("record_id", "attribute_name", F.substring(identifiers.fingerprint(F.col("product_id"), F.regexp_replace(F.lower("attribute_name"), "[ /-]", "_")), 1, 24).alias("stable_id"))


K7_SQL = "SELECT record_id, a AS attribute_name, substring(sha256(concat_ws('|', coalesce(product_id, ''), regexp_replace(lower(a), '[ /-]', '_', 'g'))), 1, 24) AS stable_id FROM (SELECT record_id, product_id, unnest(map_keys(expected_attributes)) AS a FROM expected_products)"


def C33_snippets(spark, sf_dir):
    """The first 500 characters from where a mobile text names the part number."""
    r = rows(spark, sf_dir).filter("mfg_part_num is not null and mobile_desc is not null")
    at = F.instr(F.col("mobile_desc"), F.col("mfg_part_num"))
    return r.filter(at > 0).select("row_id", F.substring("mobile_desc", at, F.lit(500)).alias("snippet"))


C33_SQL = "SELECT row_id, substring(mobile_desc, instr(mobile_desc, mfg_part_num), 500) AS snippet FROM delivery_rows WHERE instr(mobile_desc, mfg_part_num) > 0"


def S12_master(spark, sf_dir):
    """Makers and brands as one master: each brand with its maker and the maker's name without its legal form."""
    r = table(spark, sf_dir, "registry_records")
    m = r.filter("record_kind = 'MANUFACTURER'").select(F.col("record_id").alias("manufacturer_id"), F.col("canonical_name").alias("maker"))
    b = r.filter("record_kind = 'BRAND'").select("manufacturer_id", F.col("canonical_name").alias("brand"))
    short = F.trim(F.regexp_replace("maker", r"\s+(Inc|LLC|Ltd|Co|Corp|GmbH)\.?$", ""))
    return m.join(broadcast_if_small(b, b.count()), "manufacturer_id", "left").select("manufacturer_id", "maker", short.alias("short_name"), "brand")


S12_SQL = r"SELECT m.record_id AS manufacturer_id, m.canonical_name AS maker, trim(regexp_replace(m.canonical_name, '\s+(Inc|LLC|Ltd|Co|Corp|GmbH)\.?$', '')) AS short_name, b.canonical_name AS brand FROM registry_records m LEFT JOIN registry_records b ON b.manufacturer_id = m.record_id AND b.record_kind = 'BRAND' WHERE m.record_kind = 'MANUFACTURER'"

_PAIRS = [
    (J11_family, J11_SQL), (J15_records_of_products, J15_SQL), (J21_mpn_in_description, J21_SQL), (J22_candidate_urls, J22_SQL), (X2_missing_attributes, X2_SQL), (W5_image_roles, W5_SQL), (T8_spec_line, T8_SQL), (C8_code_tokens, C8_SQL),
    (C15_features, C15_SQL), (C19_description_checks, C19_SQL), (M3_fraction_table, M3_SQL), (M4_identity_score, M4_SQL), (M7_running_budget, M7_SQL), (X9_known_hosts, X9_SQL), (F14_private_hosts, F14_SQL), (P4_attribute_payload, P4_ATTRIBUTE_SQL),
    (P10_snapshot, P10_SQL), (K7_stable_ids, K7_SQL), (C33_snippets, C33_SQL), (S12_master, S12_SQL),
]
QUERIES = {f.__name__: f for f, _ in _PAIRS}
SQL = {f.__name__: s for f, s in _PAIRS if s}
