"""Named queries: reference joins, conflicts, evidence, delivery shapes, metrics and timelines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partwright.functions import numbers, text, urls
from partwright.operators import delivery, evidence, nested, registry, timeline
from partwright.plans.profiling import RAW, _COLLAPSE, _KEY, rows
from partwright.session import join_values, table

_NAMES = "SELECT record_id, record_kind, unnest(list_concat([canonical_name], coalesce(aliases, []))) AS name FROM registry_records"


def _maker_values(spark, sf_dir):
    return rows(spark, sf_dir).select(text.without_code(F.col("part_manuf")).alias("value"))


_MAKERS = r"SELECT DISTINCT regexp_replace(regexp_replace(part_manuf, '\s*\([A-Za-z0-9-]+\)\s*$', ''), '^[\s ]+|[\s ]+$', '', 'g') AS value FROM delivery_rows WHERE part_manuf IS NOT NULL"


def J1_tiered_resolution(spark, sf_dir):
    return registry.resolve(_maker_values(spark, sf_dir), table(spark, sf_dir, "registry_records"), "MANUFACTURER")


J1_SQL = f"""
WITH n AS (SELECT * FROM ({_NAMES}) WHERE record_kind = 'MANUFACTURER'), v AS (SELECT * FROM ({_MAKERS}) WHERE trim(value) <> ''),
k AS (SELECT record_id, 1 AS tier, name AS key FROM n UNION SELECT record_id, 2, lower({_COLLAPSE.format(c='name')}) FROM n UNION SELECT record_id, 3, {_KEY.format(c='name')} FROM n),
q AS (SELECT value, 1 AS tier, value AS key FROM v UNION ALL SELECT value, 2, lower({_COLLAPSE.format(c='value')}) FROM v UNION ALL SELECT value, 3, {_KEY.format(c='value')} FROM v),
h AS (SELECT value, tier, count(DISTINCT record_id) AS n, min(record_id) AS id FROM q JOIN k USING (tier, key) WHERE key <> '' GROUP BY 1, 2),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY value ORDER BY tier) = 1)
SELECT v.value, CASE WHEN b.n IS NULL THEN 'UNRESOLVED' WHEN b.n = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status, b.tier, CASE WHEN b.n = 1 THEN id END AS record_id, coalesce(b.n, 0) AS n_candidates FROM v LEFT JOIN b USING (value)
"""


def J2_fuzzy(spark, sf_dir):
    """Candidates for makers no tier resolves; by matching blocks, which SQL has no function for."""
    open_values = J1_tiered_resolution(spark, sf_dir).filter("status = 'UNRESOLVED'").select("value")
    return registry.fuzzy(open_values, table(spark, sf_dir, "registry_records"), "MANUFACTURER")


def J4_by_code(spark, sf_dir):
    code = F.lower(text.code_suffix(F.col("part_manuf")))
    codes = table(spark, sf_dir, "registry_records").filter("record_kind = 'MANUFACTURER'").groupBy(F.lower("code").alias("code")).agg(F.max("record_id").alias("record_id"))
    return rows(spark, sf_dir).filter(code.isNotNull()).select("row_id", code.alias("code")).join(F.broadcast(codes) if codes.count() <= 200_000 else codes, "code", "left").select("row_id", "code", "record_id")


J4_SQL = r"""
WITH r AS (SELECT row_id, lower(nullif(regexp_extract(part_manuf, '\(([A-Za-z0-9-]+)\)\s*$', 1), '')) AS code FROM delivery_rows),
c AS (SELECT lower(code) AS code, max(record_id) AS record_id FROM registry_records WHERE record_kind = 'MANUFACTURER' GROUP BY 1)
SELECT row_id, code, record_id FROM r LEFT JOIN c USING (code) WHERE code IS NOT NULL
"""


def J6_only_parent(spark, sf_dir):
    return registry.only_parent(table(spark, sf_dir, "registry_records"))


J6_SQL = f"SELECT {_KEY.format(c='canonical_name')} AS brand_key, min(manufacturer_id) AS manufacturer_id FROM registry_records WHERE record_kind = 'BRAND' AND manufacturer_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT manufacturer_id) = 1"


def J12_longest_prefix(spark, sf_dir):
    """Part numbers to the commonest dealer of their series, by the longest known series prefix."""
    r = rows(spark, sf_dir).filter("mfg_part_num is not null")
    series = [r.select(F.upper(F.substring("mfg_part_num", 1, n)).alias("prefix"), F.lit(n).alias("n")) for n in (2, 4)]
    prefixes = series[0].unionByName(series[1]).filter(F.length("prefix") == F.col("n")).groupBy("prefix").agg(F.count(F.lit(1)).alias("c")).filter("c >= 20").select("prefix", F.concat(F.lit("series "), F.col("prefix")).alias("label"))
    return registry.longest_prefix(r.select("row_id", "mfg_part_num"), "mfg_part_num", prefixes).select("row_id", "label")


J12_SQL = """
WITH r AS (SELECT row_id, mfg_part_num AS m FROM delivery_rows WHERE mfg_part_num IS NOT NULL),
p AS (SELECT p FROM (SELECT upper(m[1:2]) AS p FROM r WHERE length(m) >= 2 UNION ALL SELECT upper(m[1:4]) FROM r WHERE length(m) >= 4) GROUP BY 1 HAVING count(*) >= 20)
SELECT row_id, 'series ' || coalesce(b.p, a.p) AS label FROM r LEFT JOIN p a ON upper(m[1:2]) = a.p AND length(m) >= 2 LEFT JOIN p b ON upper(m[1:4]) = b.p AND length(m) >= 4
"""


def J7_rule_for(spark, sf_dir):
    lov = table(spark, sf_dir, "lov_rules").select(F.array_join("classpath_nodes", " > ").alias("classpath"), F.col("leaf_node").alias("leaf"), F.col("attribute_label").alias("attribute"), "rule_id")
    path = rows(spark, sf_dir).filter("classpath is not null").groupBy("product_id").agg(F.min_by("classpath", "row_id").alias("classpath"))
    asked = table(spark, sf_dir, "expected_products").select("product_id", F.explode(F.map_keys("expected_attributes")).alias("attribute")).distinct().join(path, "product_id")
    asked = asked.withColumn("leaf", F.trim(F.substring_index("classpath", ">", -1)))
    return registry.rule_for(asked, lov).select("product_id", "attribute", "rule_id", "tier")


J7_SQL = """
WITH l AS (SELECT array_to_string(classpath_nodes, ' > ') AS classpath, leaf_node AS leaf, attribute_label AS attribute, rule_id FROM lov_rules),
d AS (SELECT product_id, arg_min(classpath, row_id) AS classpath FROM delivery_rows WHERE classpath IS NOT NULL GROUP BY 1),
q AS (SELECT DISTINCT e.product_id, attribute, classpath, trim(string_split(classpath, '>')[-1]) AS leaf FROM (SELECT product_id, unnest(map_keys(expected_attributes)) AS attribute FROM expected_products) e JOIN d USING (product_id)),
a AS (SELECT classpath, attribute, min(rule_id) AS a FROM l GROUP BY 1, 2), b AS (SELECT leaf, attribute, min(rule_id) AS b FROM l GROUP BY 1, 2), c AS (SELECT attribute, min(rule_id) AS c FROM l GROUP BY 1 HAVING count(*) = 1)
SELECT product_id, attribute, coalesce(a, b, c) AS rule_id, CASE WHEN a IS NOT NULL THEN 'path' WHEN b IS NOT NULL THEN 'leaf' WHEN c IS NOT NULL THEN 'attribute' END AS tier
FROM q LEFT JOIN a USING (classpath, attribute) LEFT JOIN b USING (leaf, attribute) LEFT JOIN c USING (attribute)
"""


def W1_forward_fill(spark, sf_dir):
    """Rules written as in a sheet, with a cell left blank where it repeats the one above, and filled again."""
    one = Window.partitionBy("sheet").orderBy("rule_id")
    lov = table(spark, sf_dir, "lov_rules").select(F.lit("global").alias("sheet"), "rule_id", F.array_join("classpath_nodes", " > ").alias("classpath"), "leaf_node", "attribute_label")
    blank = lov.select("sheet", "rule_id", *[F.when(F.col(c).eqNullSafe(F.lag(c).over(one)), "").otherwise(F.col(c)).alias(c) for c in ("classpath", "leaf_node", "attribute_label")])
    return registry.controlled_rules(blank).drop("sheet")


W1_SQL = "SELECT rule_id, array_to_string(classpath_nodes, ' > ') AS classpath, leaf_node, attribute_label FROM lov_rules"


def A16_allowed_values(spark, sf_dir):
    v = table(spark, sf_dir, "lov_rules").select("attribute_label", F.explode(F.split("attribute_values", "\n")).alias("v")).select("attribute_label", F.trim("v").alias("v")).filter("v != ''").distinct()
    return v.groupBy("attribute_label").agg(F.count(F.lit(1)).alias("n_values"), F.array_join(F.array_sort(F.collect_list("v")), "; ").alias("allowed"))


A16_SQL = "WITH v AS (SELECT DISTINCT attribute_label, trim(x) AS v FROM (SELECT attribute_label, unnest(string_split(attribute_values, chr(10))) AS x FROM lov_rules) WHERE trim(x) <> '') SELECT attribute_label, count(*) AS n_values, array_to_string(list_sort(list(v)), '; ') AS allowed FROM v GROUP BY 1"


def J14_domains(spark, sf_dir):
    """The hosts under which each maker's pages were found, in first-seen order."""
    h = table(spark, sf_dir, "source_context").select("context_id", F.lower(F.trim("manufacturer")).alias("maker"), urls.host(F.col("canonical_product_url")).alias("host")).filter("maker != '' and host is not null")
    first = h.groupBy("maker", "host").agg(F.min("context_id").alias("f"), F.count(F.lit(1)).alias("n_pages"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("maker").orderBy("f"))).select("maker", "host", "place", "n_pages")


J14_SQL = r"""
WITH h AS (SELECT context_id, lower(trim(manufacturer)) AS maker, nullif(regexp_replace(regexp_extract(lower(trim(canonical_product_url)), '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1), '\.$', ''), '') AS host FROM source_context),
f AS (SELECT maker, host, min(context_id) AS f, count(*) AS n_pages FROM h WHERE maker <> '' AND host IS NOT NULL GROUP BY 1, 2)
SELECT maker, host, CAST(row_number() OVER (PARTITION BY maker ORDER BY f) AS INTEGER) AS place, n_pages FROM f
"""


def J16_uncovered_pages(spark, sf_dir):
    """Pages whose product no golden record holds."""
    pages = table(spark, sf_dir, "source_context").select("context_id", F.array("product_id").alias("cited"))
    return evidence.cited_unknown(pages, "cited", table(spark, sf_dir, "expected_products"), "product_id", "context_id")


J16_SQL = "SELECT context_id, 1::BIGINT AS n_unknown FROM source_context s WHERE NOT EXISTS (SELECT 1 FROM expected_products e WHERE e.product_id = s.product_id)"


def J24_duplicate_classes(spark, sf_dir):
    """Classes of rows with the same part number: EXACT where all name one maker, else POSSIBLE; one row per member."""
    r = rows(spark, sf_dir).select("row_id", F.upper(F.trim("mfg_part_num")).alias("k"), F.lower(F.trim(text.without_code(F.col("part_manuf")))).alias("m")).filter("k != ''")
    c = r.groupBy("k").agg(F.min("row_id").alias("class_id"), F.count(F.lit(1)).alias("n_members"), F.count("m").alias("n_named"), F.min("m").alias("lo"), F.max("m").alias("hi")).filter("n_members > 1")
    verdict = F.when((F.col("lo") == F.col("hi")) & (F.col("n_named") == F.col("n_members")), "EXACT").otherwise("POSSIBLE")
    classes = c.select("k", "class_id", "n_members", verdict.alias("verdict"), F.col("n_members").alias("_n"))
    return join_values(r, classes, ["k"], "_n", r.count()).select("row_id", "class_id", "n_members", "verdict")


J24_SQL = r"""
WITH r AS (SELECT row_id, upper(trim(mfg_part_num)) AS k, lower(trim(regexp_replace(regexp_replace(part_manuf, '\s*\([A-Za-z0-9-]+\)\s*$', ''), '^[\s ]+|[\s ]+$', '', 'g'))) AS m FROM delivery_rows WHERE trim(mfg_part_num) <> ''),
c AS (SELECT k, min(row_id) AS class_id, count(*) AS n_members, CASE WHEN min(m) = max(m) AND count(m) = count(*) THEN 'EXACT' ELSE 'POSSIBLE' END AS verdict FROM r GROUP BY 1 HAVING count(*) > 1)
SELECT row_id, class_id, n_members, verdict FROM r JOIN c USING (k)
"""

_FEED_RANK = {"maker_page": 0, "pdf_extract": 1, "metric_pim": 2, "dealer_sheet": 3, "translated": 4}


def _candidates(spark, sf_dir):
    e = table(spark, sf_dir, "expected_products")
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _FEED_RANK.items() for x in kv]), F.col("source_feed")), F.lit(5))
    return e.select("record_id", "product_id", rank.alias("rank"), F.explode("expected_attributes").alias("attribute_name", "value"))


_CAND = """SELECT record_id, product_id, CASE source_feed WHEN 'maker_page' THEN 0 WHEN 'pdf_extract' THEN 1 WHEN 'metric_pim' THEN 2 WHEN 'dealer_sheet' THEN 3 WHEN 'translated' THEN 4 ELSE 5 END AS rank,
 unnest(map_keys(expected_attributes)) AS attribute_name, unnest(map_values(expected_attributes)) AS value FROM expected_products"""


def A11_conflicts(spark, sf_dir):
    return evidence.conflicts(_candidates(spark, sf_dir), ["product_id", "attribute_name"], "value", "record_id")


A11_SQL = f"""
WITH c AS (SELECT *, {_COLLAPSE.format(c='value')} AS s FROM ({_CAND})), f AS (SELECT product_id, attribute_name, lower(s) AS v, min(record_id) AS r, arg_min(s, record_id) AS s FROM c WHERE s <> '' GROUP BY 1, 2, 3)
SELECT product_id, attribute_name, count(*) AS n_values, string_agg(s, ' | ' ORDER BY r, s) AS values FROM f GROUP BY 1, 2 HAVING count(*) > 1
"""


def M8_settled(spark, sf_dir):
    return evidence.settle(_candidates(spark, sf_dir), ["product_id", "attribute_name"], "value", "rank", "record_id")


M8_SQL = f"""
WITH c AS (SELECT *, {_COLLAPSE.format(c='value')} AS s FROM ({_CAND})), f AS (SELECT product_id, attribute_name, lower(s) AS v, min(rank) AS r, min(record_id) AS i, arg_min(s, record_id) AS s FROM c WHERE s <> '' GROUP BY 1, 2, 3),
b AS (SELECT product_id, attribute_name, min(r) AS top, count(*) AS n_values FROM f GROUP BY 1, 2),
t AS (SELECT product_id, attribute_name, top, n_values, count(*) AS n_top, arg_min(s, i) AS s FROM f JOIN b USING (product_id, attribute_name) WHERE r = top GROUP BY ALL)
SELECT product_id, attribute_name, CASE WHEN n_values = 1 THEN 'CLEAR' WHEN n_top = 1 THEN 'AUTHORITATIVE' WHEN top <= 1 THEN 'ESCALATE' ELSE 'REVIEW' END AS resolution, CASE WHEN n_values = 1 OR n_top = 1 THEN s END AS chosen, n_values FROM t
"""


def C22_support(spark, sf_dir):
    """Whether the page of a product supports its golden values; the word tests have no short SQL form."""
    e = _candidates(spark, sf_dir).filter("trim(value) != ''").select("record_id", "product_id", "attribute_name", "value")
    p = table(spark, sf_dir, "source_context").filter("page_text is not null").select("context_id", "product_id", "page_text")
    return e.join(p, "product_id").select("record_id", "context_id", "attribute_name", text.supports(F.col("value"), F.col("page_text")).alias("verdict"))


def T6_top_chunks(spark, sf_dir):
    """The documents that name each subject's words most often."""
    s = table(spark, sf_dir, "subject_areas")
    terms = s.select("subject_id", F.explode(F.split(F.lower("subject_name"), " ")).alias("term")).filter("length(term) >= 4").distinct()
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text")
    return evidence.top_chunks(d.withColumn("ord", F.col("doc_id")), "doc_id", "text", "ord", terms, "term", "subject_id")


T6_SQL = r"""
WITH t AS (SELECT subject_id, unnest(string_split(subject_name, ' ')) AS term FROM subject_areas), w AS (SELECT DISTINCT subject_id, lower(term) AS term FROM t WHERE length(term) >= 4),
d AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents WHERE text IS NOT NULL),
s AS (SELECT subject_id, doc_id, count(*) AS score FROM d JOIN w USING (term) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY score DESC, doc_id) AS place FROM s)
SELECT subject_id, doc_id, score, CAST(place AS INTEGER) AS place FROM r WHERE place <= 8
"""


def A7_upper_median(spark, sf_dir):
    return delivery.upper_median(table(spark, sf_dir, "documents"), "source", "n_chars")


A7_SQL = "SELECT source, list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1] AS upper_median, count(*) AS n FROM documents WHERE n_chars IS NOT NULL GROUP BY 1"


def A9_feed_completeness(spark, sf_dir):
    return delivery.completeness_by(rows(spark, sf_dir), "feed_source", [*RAW, "classpath", "short_desc"])


A9_SQL = "WITH v AS (" + " UNION ALL ".join(f"SELECT feed_source, '{c}' AS column_name, {c} AS v FROM delivery_rows" for c in [*RAW, "classpath", "short_desc"]) + ") SELECT feed_source, column_name, count(*) AS n_rows, count(*) FILTER (trim(v) <> '') AS n_filled, round(100.0 * count(*) FILTER (trim(v) <> '') / count(*), 2) AS pct FROM v GROUP BY 1, 2"


def M5_completeness(spark, sf_dir):
    return rows(spark, sf_dir).select("row_id", delivery.completeness([*RAW, "classpath", "short_desc"]).alias("pct"))


M5_SQL = "SELECT row_id, round_even(100.0 * (" + " + ".join(f"(coalesce(trim({c}), '') <> '')::INT" for c in [*RAW, "classpath", "short_desc"]) + ") / 8, 2)::DOUBLE AS pct FROM delivery_rows"


def F21_row_categories(spark, sf_dir):
    return delivery.category_counts(rows(spark, sf_dir))


F21_SQL = r"""
WITH k AS (SELECT count(*) OVER (PARTITION BY lower(mfg_part_num)) AS n_mpn, * FROM delivery_rows),
c AS (SELECT 'no_mpn' AS category FROM k WHERE coalesce(trim(mfg_part_num), '') = '' UNION ALL SELECT 'repeated_mpn' FROM k WHERE n_mpn > 1 AND trim(mfg_part_num) <> '' UNION ALL SELECT 'no_description' FROM k WHERE coalesce(trim(part_desc), '') = ''
 UNION ALL SELECT 'no_maker' FROM k WHERE coalesce(trim(part_manuf), '') = '' UNION ALL SELECT 'maker_code' FROM k WHERE regexp_matches(part_manuf, '\([A-Za-z0-9-]+\)\s*$') UNION ALL SELECT 'no_classpath' FROM k WHERE coalesce(trim(classpath), '') = ''
 UNION ALL SELECT 'fraction_size' FROM k WHERE regexp_matches(part_desc, '[0-9]/[0-9]'))
SELECT category, count(*) AS n_rows FROM c GROUP BY 1
"""


# The slots of the delivery file.
SLOTS = 50


def P3_attribute_slots(spark, sf_dir):
    return delivery.attribute_slots(table(spark, sf_dir, "expected_products"), "record_id", "expected_attributes", SLOTS)


def P3_beyond_slots(spark, sf_dir):
    """The attributes after the last slot as long rows."""
    return delivery.beyond_slots(table(spark, sf_dir, "expected_products"), "record_id", "expected_attributes", SLOTS)


_VALUE_UNIT = numbers._VALUE_UNIT.replace("'", "''")


def numbered_sql(source: str = "expected_products") -> str:
    """Attributes with a value, numbered in the order written, as (record_id, place, label, value, uom)."""
    return f"""
SELECT record_id, CAST(row_number() OVER (PARTITION BY record_id ORDER BY o) AS INTEGER) AS place, label,
 CASE WHEN regexp_extract(raw, '{_VALUE_UNIT}', 1) <> '' THEN regexp_extract(raw, '{_VALUE_UNIT}', 1) ELSE trim(raw) END AS value, nullif(regexp_extract(raw, '{_VALUE_UNIT}', 2), '') AS uom
FROM (SELECT record_id, unnest(map_keys(expected_attributes)) AS label, unnest(map_values(expected_attributes)) AS raw, generate_subscripts(map_keys(expected_attributes), 1) AS o FROM {source}) WHERE regexp_matches(raw, '\\S')
"""


def slots_sql(slots: int, source: str = "expected_products") -> str:
    places = ", ".join(f"max({c}) FILTER (place = {i}) AS {c}_{i}" for i in range(1, slots + 1) for c in ("label", "value", "uom"))
    return f"WITH a AS ({numbered_sql(source)}) SELECT record_id, CAST(count(place) AS INTEGER) AS n_attributes, {places} FROM {source} LEFT JOIN a USING (record_id) GROUP BY record_id"


def beyond_sql(slots: int, source: str = "expected_products") -> str:
    return f"SELECT * FROM ({numbered_sql(source)}) WHERE place > {slots}"


def X5_asset_urls(spark, sf_dir):
    return delivery.ordered_urls(table(spark, sf_dir, "source_context"), "context_id", ["image_urls", "document_urls"])


X5_SQL = """
WITH u AS (SELECT context_id, unnest(list_concat(coalesce(image_urls, []), coalesce(document_urls, []))) AS url, generate_subscripts(list_concat(coalesce(image_urls, []), coalesce(document_urls, [])), 1) AS o FROM source_context),
f AS (SELECT context_id, url, min(o) AS o FROM u WHERE url IS NOT NULL GROUP BY 1, 2)
SELECT context_id, url, CAST(row_number() OVER (PARTITION BY context_id ORDER BY o) AS INTEGER) AS place FROM f
"""


def C27_asset_types(spark, sf_dir):
    """What each document of a page is, and whether it is about the page's product."""
    p = table(spark, sf_dir, "source_context").select("context_id", "mpn", F.posexplode("document_urls").alias("o", "url")).filter("url is not null")
    return p.select("context_id", (F.col("o") + 1).alias("place"), delivery.asset_type(F.col("url")).alias("asset_type"), delivery.association(F.col("url"), F.col("mpn")).alias("scope"), delivery.document_rank(F.col("url")).alias("rank"))


_DOCUMENTS = "SELECT context_id, mpn, unnest(document_urls) AS url, generate_subscripts(document_urls, 1) AS o FROM source_context"


def _ladder(c: str, rungs: list[tuple[str, list[str]]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{'|'.join(re.escape(w).replace(chr(39), chr(39) * 2) for w in words)}') THEN {name}" for name, words in rungs) + f" ELSE {other} END"


C27_SQL = f"""
SELECT context_id, CAST(o AS INTEGER) AS place, {_ladder("lower(url)", [(f"'{n}'", w) for n, w in delivery.ASSET_TYPES], "'other_document'")} AS asset_type,
 CASE WHEN coalesce(trim(mpn), '') = '' OR contains(lower(url), lower(trim(mpn))) OR contains(regexp_replace(lower(url), '[-_ ]', '', 'g'), regexp_replace(lower(trim(mpn)), '[- ]', '', 'g')) OR NOT regexp_matches(lower(url), 'warranty|full line|general catalog|brochure') THEN 'PRODUCT_SPECIFIC' ELSE 'MANUFACTURER_GENERAL' END AS scope,
 CAST({_ladder("lower(url)", [(str(i), [w for w in ws if w != '.pdf']) for i, ws in enumerate(delivery.DOCUMENT_ORDER[:4], 1)], "CASE WHEN lower(url) LIKE '%.pdf' OR regexp_matches(lower(url), 'document|download|/pdf') THEN 5 ELSE 6 END")} AS INTEGER) AS rank
FROM ({_DOCUMENTS}) WHERE url IS NOT NULL
"""


def C16_descriptions(spark, sf_dir):
    return delivery.descriptions(rows(spark, sf_dir))


C16_SQL = r"""
SELECT row_id, rtrim(substring(upper(concat_ws(' ', nullif(trim(part_manuf), ''), nullif(trim(mfg_part_num), ''), nullif(trim(part_desc), ''))), 1, 60)) AS invoice_text,
 rtrim(substring(concat_ws(', ', nullif(trim(mfg_part_num), ''), nullif(trim(part_desc), ''), nullif(trim(classpath), '')), 1, 150)) AS short_text FROM delivery_rows
"""


def W3_rolling_load(spark, sf_dir):
    return timeline.rolling_load(table(spark, sf_dir, "events"), ["user_id"], "ts", 86400).select("event_id", "in_window")


W3_SQL = "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS in_window FROM events"


def W7_failure_streaks(spark, sf_dir):
    return timeline.failure_streaks(table(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") == "error", 2).select("event_id", F.col("streak").cast("bigint").alias("streak"), "state")


W7_SQL = """
WITH i AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
s AS (SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, i ORDER BY ts) AS BIGINT) AS streak FROM i)
SELECT event_id, streak, CASE WHEN streak >= 2 THEN 'OPEN' ELSE 'CLOSED' END AS state FROM s
"""


def W3_admitted(spark, sf_dir):
    """Sequential admission, which a window cannot express."""
    return timeline.admitted(table(spark, sf_dir, "events"), "user_id", "ts", "value", 3, 500.0, 86400 * 30)


def U5_cache_state(spark, sf_dir):
    p = table(spark, sf_dir, "source_context").withColumn("host", urls.host(F.col("canonical_product_url"))).filter("host is not null and fetched_at is not null")
    at = p.agg(F.max("fetched_at").alias("m")).first()["m"]
    return timeline.fresh(p, ["host"], "fetched_at", F.lit(at).cast("timestamp_ntz"), 86400).select("host", "last_ts", "state")


U5_SQL = r"""
WITH h AS (SELECT nullif(regexp_replace(regexp_extract(lower(trim(canonical_product_url)), '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1), '\.$', ''), '') AS host, fetched_at FROM source_context WHERE fetched_at IS NOT NULL),
m AS (SELECT max(fetched_at) AS m FROM h WHERE host IS NOT NULL)
SELECT host, max(fetched_at) AS last_ts, CASE WHEN epoch_us((SELECT m FROM m)) - epoch_us(max(fetched_at)) < 86400000000 THEN 'HIT' ELSE 'STALE' END AS state FROM h WHERE host IS NOT NULL GROUP BY 1
"""


def R5_load_once(spark, sf_dir):
    """Products of the golden records that the pages do not have yet, once each."""
    return timeline.load_once(table(spark, sf_dir, "source_context"), table(spark, sf_dir, "expected_products").select("product_id"), ["product_id"])


R5_SQL = "SELECT DISTINCT product_id FROM expected_products e WHERE NOT EXISTS (SELECT 1 FROM source_context s WHERE s.product_id = e.product_id)"


def K6_latest_records(spark, sf_dir):
    """The last version of each product's golden record."""
    e = table(spark, sf_dir, "expected_products").select("product_id", "record_id", "captured_at", "source_feed", "mpn")
    return timeline.latest(e, ["product_id"], ["record_id"])


K6_SQL = "SELECT product_id, record_id, captured_at, source_feed, mpn FROM expected_products QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY record_id DESC) = 1"


def A15_trace_totals(spark, sf_dir):
    """Files, declared rows and workers per execution mode; totals are null where no file states any."""
    d = nested.parsed(table(spark, sf_dir, "trace_runs"), "run_id", "payload")
    get = lambda k, t: F.coalesce(F.try_variant_get("doc", f"$.{k}", t), F.try_variant_get("doc", f"$.report.meta.{k}", t))
    r = d.select(get("execution_mode", "string").alias("execution_mode"), get("total_rows", "bigint").alias("n"), get("workers", "bigint").alias("w"))
    return r.groupBy("execution_mode").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("total_rows"), F.max("w").alias("most_workers"))


A15_SQL = r"""
WITH p AS (SELECT CAST(ltrim(payload, chr(65279)) AS VARCHAR) AS j FROM trace_runs), v AS (SELECT j FROM p WHERE json_valid(j)),
r AS (SELECT coalesce(json_extract_string(j, '$.execution_mode'), json_extract_string(j, '$.report.meta.execution_mode')) AS execution_mode, CAST(coalesce(json_extract_string(j, '$.total_rows'), json_extract_string(j, '$.report.meta.total_rows')) AS BIGINT) AS n, CAST(coalesce(json_extract_string(j, '$.workers'), json_extract_string(j, '$.report.meta.workers')) AS BIGINT) AS w FROM v)
SELECT execution_mode, count(*) AS n_files, CAST(sum(n) AS BIGINT) AS total_rows, max(w) AS most_workers FROM r GROUP BY 1
"""


def M18_late_rows(spark, sf_dir):
    r = rows(spark, sf_dir).filter("exported_at is not null and received_at is not null")
    ms = F.floor((F.unix_micros(F.col("received_at").cast("timestamp")) - F.unix_micros(F.col("exported_at").cast("timestamp"))) / 1000)
    return r.groupBy("feed_source").agg(F.count(F.lit(1)).alias("n_rows"), F.max(ms).alias("longest_ms"), F.sum((ms > 7 * 86400 * 1000).cast("bigint")).alias("n_late"))


M18_SQL = "SELECT feed_source, count(*) AS n_rows, max((epoch_us(received_at) - epoch_us(exported_at)) // 1000) AS longest_ms, count(*) FILTER ((epoch_us(received_at) - epoch_us(exported_at)) // 1000 > 604800000) AS n_late FROM delivery_rows WHERE exported_at IS NOT NULL AND received_at IS NOT NULL GROUP BY 1"

_PAIRS = [
    (J1_tiered_resolution, J1_SQL), (J2_fuzzy, None), (J4_by_code, J4_SQL), (J6_only_parent, J6_SQL), (J12_longest_prefix, J12_SQL), (J7_rule_for, J7_SQL), (W1_forward_fill, W1_SQL), (A16_allowed_values, A16_SQL),
    (J14_domains, J14_SQL), (J16_uncovered_pages, J16_SQL), (J24_duplicate_classes, J24_SQL), (A11_conflicts, A11_SQL), (M8_settled, M8_SQL), (C22_support, None), (T6_top_chunks, T6_SQL), (A7_upper_median, A7_SQL),
    (A9_feed_completeness, A9_SQL), (M5_completeness, M5_SQL), (F21_row_categories, F21_SQL), (P3_attribute_slots, slots_sql(SLOTS)), (P3_beyond_slots, beyond_sql(SLOTS)), (X5_asset_urls, X5_SQL), (C27_asset_types, C27_SQL), (C16_descriptions, C16_SQL), (W3_rolling_load, W3_SQL),
    (W7_failure_streaks, W7_SQL), (W3_admitted, None), (U5_cache_state, U5_SQL), (R5_load_once, R5_SQL), (K6_latest_records, K6_SQL), (A15_trace_totals, A15_SQL), (M18_late_rows, M18_SQL),
]
QUERIES = {f.__name__: f for f, _ in _PAIRS}
SQL = {f.__name__: s for f, s in _PAIRS if s}
