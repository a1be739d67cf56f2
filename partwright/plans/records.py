"""Named queries: delivery records, scoped and tiered resolution, measures, samples, set operations, links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partwright.functions import text, urls
from partwright.operators import delivery, evidence, nested, registry
from partwright.plans import catalogue
from partwright.plans.profiling import RAW, _KEY, rows
from partwright.session import broadcast_if_small, table

_HOST = r"nullif(regexp_replace(regexp_extract(lower(trim({c})), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '\.$', ''), '')"
_PLACE = "('-- Unbranded --', '-- No Unilog Brand --', '-- No DIB Brand --')"
_STRIP = r"regexp_replace({c}, '^[\s ]+|[\s ]+$', '', 'g')"


def _feeds(spark, sf_dir):
    return table(spark, sf_dir, "expected_products")


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "source_context")


# Delivery record: raw columns as they came, the page's address and links, the attribute slots, how much is filled.
PASSED = ["mfg_part_num", "part_desc", "e1_brand", "unilog_brand", "dib_brand", "part_manuf", "classpath", "mobile_desc", "invoice_desc", "short_desc"]


def P1_delivery_record(spark, sf_dir):
    """The wide record of each golden product: 50 slots of label, value and uom in the order written, beside what was delivered and found first."""
    slots = delivery.attribute_slots(_feeds(spark, sf_dir), "record_id", "expected_attributes", catalogue.SLOTS)
    e = _feeds(spark, sf_dir).select("record_id", "product_id", "mpn", "manufacturer", "canonical_url")
    r = rows(spark, sf_dir).groupBy("product_id").agg(F.min_by(F.struct(*PASSED), "row_id").alias("r"))
    p = _pages(spark, sf_dir).groupBy("product_id").agg(F.min_by(F.struct("canonical_product_url", "image_urls", "document_urls"), "context_id").alias("p"))
    image = lambda i: F.try_element_at(F.col("p.image_urls"), F.lit(i))
    wide = e.join(r, "product_id", "left").join(p, "product_id", "left").join(slots, "record_id")
    return wide.select(
        "record_id", "product_id", F.coalesce("mpn", "r.mfg_part_num").alias("part_number"), F.coalesce("manufacturer", "r.part_manuf").alias("maker"), F.coalesce("canonical_url", "p.canonical_product_url").alias("url"),
        *[F.col(f"r.{c}").alias(c) for c in PASSED], image(1).alias("primary_image"), image(2).alias("alternate_image"), F.try_element_at(F.col("p.document_urls"), F.lit(1)).alias("document"),
        "n_attributes", *[f"{c}_{i}" for i in range(1, catalogue.SLOTS + 1) for c in ("label", "value", "uom")],
    )


P1_SQL = f"""
WITH s AS ({catalogue.slots_sql(catalogue.SLOTS)}),
r AS (SELECT * FROM delivery_rows QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY row_id) = 1), p AS (SELECT * FROM source_context QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY context_id) = 1)
SELECT e.record_id, e.product_id, coalesce(e.mpn, r.mfg_part_num) AS part_number, coalesce(e.manufacturer, r.part_manuf) AS maker, coalesce(e.canonical_url, p.canonical_product_url) AS url,
 {", ".join(f"r.{c}" for c in PASSED)}, p.image_urls[1] AS primary_image, p.image_urls[2] AS alternate_image, p.document_urls[1] AS document, s.* EXCLUDE (record_id)
FROM expected_products e LEFT JOIN r USING (product_id) LEFT JOIN p ON p.product_id = e.product_id JOIN s ON s.record_id = e.record_id
"""


def P2_raw_projection(spark, sf_dir):
    """The delivery columns that a contract asks for, in its order; names that the rows lack come as null."""
    have = rows(spark, sf_dir)
    return have.select("row_id", *[F.col(c) if c in have.columns else F.lit(None).cast("string").alias(c) for c in [*PASSED, "upc"]])


P2_SQL = f"SELECT row_id, {', '.join(PASSED)}, CAST(NULL AS VARCHAR) AS upc FROM delivery_rows"


def J3_brand_of_maker(spark, sf_dir):
    """Brands of golden makers' rows, looked for among the brands of that maker only, with the reason where none is found."""
    reg = table(spark, sf_dir, "registry_records")
    makers = reg.filter("record_kind = 'MANUFACTURER'").groupBy(F.lower("code").alias("code")).agg(F.max("record_id").alias("manufacturer_id"))
    r = rows(spark, sf_dir).select(F.lower(text.code_suffix(F.col("part_manuf"))).alias("code"), text.canonical_key(F.col("e1_brand")).alias("key")).filter("code is not null and key != ''").distinct()
    asked = r.join(broadcast_if_small(makers, makers.count()), "code").select("manufacturer_id", "key").distinct()
    return registry.brand_of_maker(asked, reg)


J3_SQL = rf"""
WITH m AS (SELECT lower(code) AS code, max(record_id) AS manufacturer_id FROM registry_records WHERE record_kind = 'MANUFACTURER' GROUP BY 1),
q AS (SELECT DISTINCT manufacturer_id, key FROM (SELECT lower(nullif(regexp_extract(part_manuf, '\(([A-Za-z0-9-]+)\)\s*$', 1), '')) AS code, {_KEY.format(c='e1_brand')} AS key FROM delivery_rows) JOIN m USING (code) WHERE key <> ''),
b AS (SELECT manufacturer_id, record_id, {_KEY.format(c='name')} AS key FROM (SELECT manufacturer_id, record_id, unnest(list_concat([canonical_name], coalesce(aliases, []))) AS name FROM registry_records WHERE record_kind = 'BRAND')),
n AS (SELECT manufacturer_id, key, count(DISTINCT record_id) AS n, min(record_id) AS id FROM b WHERE key <> '' GROUP BY 1, 2), o AS (SELECT DISTINCT manufacturer_id FROM b)
SELECT q.manufacturer_id, q.key, CASE WHEN n.n = 1 THEN n.id END AS record_id, CASE WHEN o.manufacturer_id IS NULL THEN 'no_brands_for_manufacturer' WHEN n.n IS NULL THEN 'unresolved' WHEN n.n > 1 THEN 'ambiguous' ELSE 'resolved' END AS reason
FROM q LEFT JOIN o USING (manufacturer_id) LEFT JOIN n ON n.manufacturer_id = q.manufacturer_id AND n.key = q.key
"""


def _classpaths(spark, sf_dir):
    return rows(spark, sf_dir).filter("trim(classpath) != ''").select(F.trim("classpath").alias("classpath")).distinct()


def J9_category_rules(spark, sf_dir):
    """The rule sheet of each written class path: by path and leaf, path, path within path, leaf, leaf within the path, else none; the first rule of the best tier."""
    lov = table(spark, sf_dir, "lov_rules").select(F.lower(F.array_join("classpath_nodes", " > ")).alias("path"), F.lower("leaf_node").alias("leaf"), "rule_id").groupBy("path", "leaf").agg(F.min("rule_id").alias("rule_id"))
    return registry.category_rules(_classpaths(spark, sf_dir), lov)


J9_SQL = r"""
WITH l AS (SELECT lower(array_to_string(classpath_nodes, ' > ')) AS path, lower(leaf_node) AS leaf, min(rule_id) AS rule_id FROM lov_rules GROUP BY 1, 2),
q AS (SELECT DISTINCT trim(classpath) AS classpath, lower(trim(classpath)) AS asked, trim(string_split(lower(trim(classpath)), '>')[-1]) AS own FROM delivery_rows WHERE trim(classpath) <> ''),
h AS (SELECT classpath, rule_id, CASE WHEN asked = path THEN 1 WHEN contains(asked, path) OR contains(path, asked) THEN 2 WHEN own = leaf THEN 3 WHEN contains(asked, leaf) THEN 4 END AS tier FROM q, l),
b AS (SELECT classpath, tier, min(rule_id) AS rule_id FROM h WHERE tier IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY classpath ORDER BY tier) = 1)
SELECT q.classpath, b.tier, b.rule_id FROM q LEFT JOIN b USING (classpath)
"""


def J8_allowed_for(spark, sf_dir):
    """Allowed values of a label in a class: those of the class, else of the leaf's sheet, else of the label anywhere; empty lists are passed over."""
    lov = table(spark, sf_dir, "lov_rules").select(F.array_join("classpath_nodes", " > ").alias("path"), F.col("leaf_node").alias("leaf"), F.col("attribute_label").alias("label"), F.split("attribute_values", "\n").alias("v"))
    v = lov.select("path", "leaf", "label", F.explode("v").alias("v")).select("path", "leaf", "label", F.trim("v").alias("v")).filter("v != ''")
    tier = lambda name, *keys: v.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("v")), "; ").alias(name))
    asked = lov.select("path", "leaf").distinct().join(F.broadcast(lov.select("label").distinct()))
    out = asked.join(tier("a", "path", "label"), ["path", "label"], "left").join(tier("b", "leaf", "label"), ["leaf", "label"], "left").join(tier("c", "label"), "label", "left")
    return out.select("path", "label", F.coalesce("a", "b", "c").alias("allowed"), F.when(F.col("a").isNotNull(), "class").when(F.col("b").isNotNull(), "leaf").when(F.col("c").isNotNull(), "label").alias("tier"))


J8_SQL = """
WITH l AS (SELECT array_to_string(classpath_nodes, ' > ') AS path, leaf_node AS leaf, attribute_label AS label, attribute_values AS av FROM lov_rules),
v AS (SELECT path, leaf, label, trim(x) AS v FROM (SELECT *, unnest(string_split(av, chr(10))) AS x FROM l) WHERE trim(x) <> ''),
a AS (SELECT path, label, array_to_string(list_sort(list(DISTINCT v)), '; ') AS a FROM v GROUP BY 1, 2), b AS (SELECT leaf, label, array_to_string(list_sort(list(DISTINCT v)), '; ') AS b FROM v GROUP BY 1, 2), c AS (SELECT label, array_to_string(list_sort(list(DISTINCT v)), '; ') AS c FROM v GROUP BY 1),
q AS (SELECT * FROM (SELECT DISTINCT path, leaf FROM l), (SELECT DISTINCT label FROM l))
SELECT q.path, q.label, coalesce(a, b, c) AS allowed, CASE WHEN a IS NOT NULL THEN 'class' WHEN b IS NOT NULL THEN 'leaf' WHEN c IS NOT NULL THEN 'label' END AS tier
FROM q LEFT JOIN a USING (path, label) LEFT JOIN b ON b.leaf = q.leaf AND b.label = q.label LEFT JOIN c ON c.label = q.label
"""


def J13_resolved_makers(spark, sf_dir):
    """Makers by the ladder: code, exact name, series of the part number, else the raw text; with the method that told."""
    reg = table(spark, sf_dir, "registry_records").filter("record_kind = 'MANUFACTURER'")
    codes = reg.groupBy(F.lower("code").alias("code")).agg(F.max("record_id").alias("by_code"))
    names = reg.groupBy(text.canonical_key(F.col("canonical_name")).alias("name")).agg(F.min("record_id").alias("by_name"))
    r = rows(spark, sf_dir).select("row_id", "part_manuf", F.lower(text.code_suffix(F.col("part_manuf"))).alias("code"), text.canonical_key(text.without_code(F.col("part_manuf"))).alias("name"), F.upper(F.substring("mfg_part_num", 1, 2)).alias("series"))
    r = r.join(broadcast_if_small(codes, codes.count()), "code", "left").join(broadcast_if_small(names, names.count()), "name", "left")
    told = r.filter("by_code is not null and length(series) = 2").groupBy("series").agg(F.countDistinct("by_code").alias("n"), F.min("by_code").alias("by_series")).filter("n = 1").drop("n")
    r = r.join(broadcast_if_small(told, told.count()), "series", "left")
    method = F.when(F.col("by_code").isNotNull(), "code").when(F.col("by_name").isNotNull(), "name").when(F.col("by_series").isNotNull(), "series").when(F.trim("part_manuf") != "", "raw").otherwise("unresolved")
    return r.select("row_id", F.coalesce("by_code", "by_name", "by_series").alias("record_id"), method.alias("method"))


J13_SQL = rf"""
WITH m AS (SELECT * FROM registry_records WHERE record_kind = 'MANUFACTURER'), c AS (SELECT lower(code) AS code, max(record_id) AS by_code FROM m GROUP BY 1), n AS (SELECT {_KEY.format(c='canonical_name')} AS name, min(record_id) AS by_name FROM m GROUP BY 1),
r AS (SELECT row_id, part_manuf, lower(nullif(regexp_extract(part_manuf, '\(([A-Za-z0-9-]+)\)\s*$', 1), '')) AS code, {_KEY.format(c="regexp_replace(part_manuf, '\\s*\\([A-Za-z0-9-]+\\)\\s*$', '')")} AS name, upper(mfg_part_num[1:2]) AS series FROM delivery_rows),
j AS (SELECT r.*, by_code, by_name FROM r LEFT JOIN c USING (code) LEFT JOIN n USING (name)),
s AS (SELECT series, min(by_code) AS by_series FROM j WHERE by_code IS NOT NULL AND length(series) = 2 GROUP BY 1 HAVING count(DISTINCT by_code) = 1)
SELECT row_id, coalesce(by_code, by_name, by_series) AS record_id, CASE WHEN by_code IS NOT NULL THEN 'code' WHEN by_name IS NOT NULL THEN 'name' WHEN by_series IS NOT NULL THEN 'series' WHEN trim(part_manuf) <> '' THEN 'raw' ELSE 'unresolved' END AS method FROM j LEFT JOIN s USING (series)
"""


def A3_availability(spark, sf_dir):
    """How many rows have a usable value in each raw column, and how many have not."""
    sums = rows(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), *[F.sum(text.normalized(F.col(c))["normalized"].isNotNull().cast("bigint")).alias(c) for c in RAW])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("available"), (F.col("n") - F.col(c)).alias("missing")) for c in RAW])))


A3_SQL = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({_STRIP.format(c=c)} <> '' AND {_STRIP.format(c=c)} NOT IN {_PLACE}) AS available, count(*) - count(*) FILTER ({_STRIP.format(c=c)} <> '' AND {_STRIP.format(c=c)} NOT IN {_PLACE}) AS missing FROM delivery_rows" for c in RAW)


def A5_operation_counts(spark, sf_dir):
    """Outcomes counted by operation and status."""
    done = [catalogue.J1_tiered_resolution(spark, sf_dir).select(F.concat(F.lit("resolve_manufacturer."), F.lower("status")).alias("counter")), catalogue.M8_settled(spark, sf_dir).select(F.concat(F.lit("settle."), F.lower("resolution")).alias("counter"))]
    return reduce(DataFrame.unionByName, done).groupBy("counter").agg(F.count(F.lit(1)).alias("n"))


A5_SQL = f"SELECT counter, count(*) AS n FROM (SELECT 'resolve_manufacturer.' || lower(status) AS counter FROM ({catalogue.J1_SQL}) UNION ALL SELECT 'settle.' || lower(resolution) FROM ({catalogue.M8_SQL})) GROUP BY 1"


def A8_category_rates(spark, sf_dir):
    """Per category, a row being in each of those its class path names: rows, and the shares with a code, a usable brand and a page address."""
    r = rows(spark, sf_dir).filter("trim(classpath) != ''")
    cats = F.array_distinct(F.filter(F.transform(F.split("classpath", r"\s*[>/]\s*"), lambda x: F.trim(x)), lambda x: x != ""))
    rate = lambda c: F.round(100.0 * F.sum(c.cast("bigint")) / F.count(F.lit(1)), 2)
    flags = r.select(F.explode(cats).alias("category"), delivery.filled("mfg_part_num").alias("a"), text.normalized(F.col("e1_brand"))["normalized"].isNotNull().alias("b"), delivery.filled("mfr_url").alias("c"))
    return flags.groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"), rate(F.col("a")).alias("code_pct"), rate(F.col("b")).alias("brand_pct"), rate(F.col("c")).alias("url_pct"))


A8_SQL = rf"""
WITH x AS (SELECT DISTINCT row_id, trim(c) AS category FROM (SELECT row_id, unnest(string_split_regex(classpath, '\s*[>/]\s*')) AS c FROM delivery_rows WHERE trim(classpath) <> '') WHERE trim(c) <> '')
SELECT category, count(*) AS n_rows, round(100.0 * count(*) FILTER (trim(mfg_part_num) <> '') / count(*), 2) AS code_pct,
 round(100.0 * count(*) FILTER ({_STRIP.format(c='e1_brand')} <> '' AND {_STRIP.format(c='e1_brand')} NOT IN {_PLACE}) / count(*), 2) AS brand_pct, round(100.0 * count(*) FILTER (trim(mfr_url) <> '') / count(*), 2) AS url_pct
FROM x JOIN delivery_rows USING (row_id) GROUP BY 1
"""


def A10_enrichment(spark, sf_dir):
    """Per feed: attributes given, those with a value, distinct names, and records without any attribute."""
    e = _feeds(spark, sf_dir).select("source_feed", "record_id", F.explode_outer("expected_attributes").alias("k", "v"))
    return e.groupBy("source_feed").agg(F.count("k").alias("n_given"), F.sum(delivery.filled("v").cast("bigint")).alias("n_valued"), F.countDistinct("k").alias("n_names"), F.sum(F.col("k").isNull().cast("bigint")).alias("n_empty"))


A10_SQL = "WITH e AS (SELECT source_feed, record_id, CASE WHEN len(map_keys(expected_attributes)) > 0 THEN map_entries(expected_attributes) ELSE [NULL] END AS a FROM expected_products), x AS (SELECT source_feed, unnest(a) AS a FROM e) SELECT source_feed, count(a.key) AS n_given, count(*) FILTER (trim(a.value) <> '') AS n_valued, count(DISTINCT a.key) AS n_names, count(*) FILTER (a.key IS NULL) AS n_empty FROM x GROUP BY 1"


def C24_attribute_ids(spark, sf_dir):
    """The two forms of attribute identifiers: underscores, and words behind 'attribute-'."""
    l = F.trim("attribute_label")
    return table(spark, sf_dir, "lov_rules").select("attribute_label").distinct().select("attribute_label", F.regexp_replace(F.lower(l), "[ /-]", "_").alias("planner_id"), F.concat(F.lit("attribute-"), F.regexp_replace(F.lower(l), r"\s+", "-")).alias("retrieval_id"))


C24_SQL = r"SELECT DISTINCT attribute_label, regexp_replace(lower(trim(attribute_label)), '[ /-]', '_', 'g') AS planner_id, 'attribute-' || regexp_replace(lower(trim(attribute_label)), '\s+', '-', 'g') AS retrieval_id FROM lov_rules"

# Names under which one attribute is given, best first.
ALIASES = {"voltage": ["Voltage", "Volts"], "amperage": ["Amps", "Amperage"], "size": ["Diameter", "Blade Diameter", "Thickness"], "speed": ["No Load Speed", "Speed", "Feed Speed"]}


def C25_best_values(spark, sf_dir):
    """The first filled value among the names of each attribute, and the raw value of one of them."""
    at = lambda n: F.nullif(F.trim(F.try_element_at("expected_attributes", F.lit(n))), F.lit(""))
    return _feeds(spark, sf_dir).select("record_id", *[F.coalesce(*[at(n) for n in names]).alias(a) for a, names in ALIASES.items()], F.try_element_at("expected_attributes", F.lit("Diameter")).alias("raw_diameter"))


C25_SQL = "SELECT record_id, " + ", ".join("coalesce(" + ", ".join(f"nullif(trim(expected_attributes['{n}']), '')" for n in names) + f") AS {a}" for a, names in ALIASES.items()) + ", expected_attributes['Diameter'] AS raw_diameter FROM expected_products"


def T5_documents_in_order(spark, sf_dir):
    """A page's documents ranked by what their address says, in their own order where ranks tie."""
    p = _pages(spark, sf_dir).select("context_id", F.posexplode("document_urls").alias("o", "url")).filter("url is not null")
    ranked = p.withColumn("rank", delivery.document_rank(F.col("url")))
    return ranked.select("context_id", "url", "rank", F.row_number().over(Window.partitionBy("context_id").orderBy("rank", "o")).alias("place"))


T5_SQL = f"WITH d AS ({catalogue._DOCUMENTS}), r AS (SELECT context_id, url, o, CAST({catalogue._ladder('lower(url)', [(str(i), [w for w in ws if w != '.pdf']) for i, ws in enumerate(delivery.DOCUMENT_ORDER[:4], 1)], chr(67) + 'ASE WHEN lower(url) LIKE ' + chr(39) + '%.pdf' + chr(39) + ' OR regexp_matches(lower(url), ' + chr(39) + 'document|download|/pdf' + chr(39) + ') THEN 5 ELSE 6 END')} AS INTEGER) AS rank FROM d WHERE url IS NOT NULL) SELECT context_id, url, rank, CAST(row_number() OVER (PARTITION BY context_id ORDER BY rank, o) AS INTEGER) AS place FROM r"


def T7_term_presence(spark, sf_dir):
    """The four documents that hold most of a subject's words at all; of equal ones the later."""
    s = table(spark, sf_dir, "subject_areas")
    terms = s.select("subject_id", F.explode(F.split(F.lower(F.concat_ws(" ", "subject_name", "description")), r"[^\p{L}\p{N}]+")).alias("term")).filter("length(term) >= 4").distinct()
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "text", F.col("doc_id").alias("ord"))
    return evidence.top_chunks(d, "doc_id", "text", "ord", terms, "term", "subject_id", 4, presence=True)


T7_SQL = r"""
WITH w AS (SELECT DISTINCT subject_id, unnest(string_split_regex(lower(concat_ws(' ', subject_name, description)), '[^\p{L}\p{N}]+')) AS term FROM subject_areas),
d AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents WHERE text IS NOT NULL),
s AS (SELECT subject_id, doc_id, count(*) AS score FROM d JOIN w USING (term) WHERE length(term) >= 4 GROUP BY 1, 2)
SELECT subject_id, doc_id, score, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY score DESC, doc_id DESC) AS INTEGER) AS place FROM s QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY score DESC, doc_id DESC) <= 4
"""


def T9_first_rows(spark, sf_dir):
    """The first rows in file order."""
    return rows(spark, sf_dir).orderBy("row_number", "row_id").limit(25).select("row_id", "row_number", "mfg_part_num")


T9_SQL = "SELECT row_id, row_number, mfg_part_num FROM delivery_rows ORDER BY row_number, row_id LIMIT 25"


def T11_profile_rows(spark, sf_dir):
    """For each of some traits the first row that has it and is not taken yet, in the order of the traits."""
    traits = {"no_code": ~delivery.filled("mfg_part_num"), "no_maker": ~delivery.filled("part_manuf"), "no_class": ~delivery.filled("classpath"), "fraction": F.coalesce(F.col("part_desc").rlike("[0-9]/[0-9]"), F.lit(False))}
    taken, out = [], []
    have = rows(spark, sf_dir).agg(*[F.min(F.when(c, F.col("row_id"))).alias(n) for n, c in traits.items()]).first()
    for n, c in traits.items():
        row = have[n]
        if row in taken:
            row = rows(spark, sf_dir).filter(c & ~F.col("row_id").isin(taken)).agg(F.min("row_id")).first()[0]
        if row is not None:
            taken.append(row)
            out.append((n, row))
    return spark.createDataFrame(out, "trait string, row_id bigint")


T11_SQL = r"""
WITH f AS (SELECT row_id, coalesce(trim(mfg_part_num), '') = '' AS a, coalesce(trim(part_manuf), '') = '' AS b, coalesce(trim(classpath), '') = '' AS c, coalesce(regexp_matches(part_desc, '[0-9]/[0-9]'), FALSE) AS d FROM delivery_rows),
t1 AS (SELECT min(row_id) AS r FROM f WHERE a), t2 AS (SELECT min(row_id) AS r FROM f WHERE b AND row_id NOT IN (SELECT r FROM t1 WHERE r IS NOT NULL)),
t3 AS (SELECT min(row_id) AS r FROM f WHERE c AND row_id NOT IN (SELECT r FROM t1 WHERE r IS NOT NULL UNION SELECT r FROM t2 WHERE r IS NOT NULL)),
t4 AS (SELECT min(row_id) AS r FROM f WHERE d AND row_id NOT IN (SELECT r FROM t1 WHERE r IS NOT NULL UNION SELECT r FROM t2 WHERE r IS NOT NULL UNION SELECT r FROM t3 WHERE r IS NOT NULL))
SELECT * FROM (SELECT 'no_code' AS trait, r AS row_id FROM t1 UNION ALL SELECT 'no_maker', r FROM t2 UNION ALL SELECT 'no_class', r FROM t3 UNION ALL SELECT 'fraction', r FROM t4) WHERE row_id IS NOT NULL
"""


def W8_new_makers(spark, sf_dir):
    """The first row of each maker, in file order, up to 75 makers."""
    m = F.lower(F.trim("part_manuf"))
    first = rows(spark, sf_dir).filter(m != "").groupBy(m.alias("maker")).agg(F.min("row_id").alias("row_id"))
    return first.orderBy("row_id").limit(75).select("row_id", "maker")


W8_SQL = "SELECT min(row_id) AS row_id, lower(trim(part_manuf)) AS maker FROM delivery_rows WHERE trim(part_manuf) <> '' GROUP BY 2 ORDER BY 1 LIMIT 75"

# The hosts of market places, whose word is no authority; source types and authorities whose quotes count.
MARKETPLACES = ["amazon", "ebay", "walmart", "alibaba", "aliexpress", "homedepot", "lowes"]
QUOTED_TYPES = ["MANUFACTURER_PAGE", "MANUFACTURER_DOCUMENT", "MANUFACTURER_CATALOG", "AUTHORIZED_DISTRIBUTOR"]
QUOTED_AUTHORITIES = ["AUTHORITATIVE", "HIGH", "SECONDARY"]
# What a page says about itself and not about the product.
GENERIC = ["product title", "page title", "title", "canonical url", "meta description", "manufacturer part number", "brand"]


def F3_rows_of_maker(spark, sf_dir):
    """Rows of one maker apart from case, the first ten."""
    asked = rows(spark, sf_dir).filter("trim(part_manuf) != ''").groupBy(F.lower("part_manuf").alias("m")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "m").limit(1)
    return rows(spark, sf_dir).withColumn("m", F.lower("part_manuf")).join(F.broadcast(asked.select("m")), "m").orderBy("row_id").limit(10).select("row_id", "part_manuf")


F3_SQL = "WITH a AS (SELECT lower(part_manuf) AS m, count(*) AS n FROM delivery_rows WHERE trim(part_manuf) <> '' GROUP BY 1 ORDER BY n DESC, m LIMIT 1) SELECT row_id, part_manuf FROM delivery_rows WHERE lower(part_manuf) = (SELECT m FROM a) ORDER BY row_id LIMIT 10"


def F4_quotable(spark, sf_dir):
    """Golden values with the pages that may be quoted for them: pages with text, of a type and authority that count."""
    p = _pages(spark, sf_dir).filter(F.col("source_type").isin(QUOTED_TYPES) & F.col("source_authority").isin(QUOTED_AUTHORITIES) & delivery.filled("page_text")).select("product_id", "context_id", "source_type", "source_authority")
    return _feeds(spark, sf_dir).select("record_id", "product_id").join(p, "product_id").select("record_id", "context_id", "source_type", "source_authority")


F4_SQL = f"SELECT record_id, context_id, source_type, source_authority FROM expected_products JOIN source_context USING (product_id) WHERE source_type IN {tuple(QUOTED_TYPES)} AND source_authority IN {tuple(QUOTED_AUTHORITIES)} AND trim(page_text) <> ''"


def F5_verified(spark, sf_dir):
    """Golden attributes with a value that some page of the product quotes."""
    e = _feeds(spark, sf_dir).select("record_id", "product_id", F.explode("expected_attributes").alias("attribute_name", "value")).filter("trim(value) != ''")
    p = _pages(spark, sf_dir).filter("page_text is not null").select("product_id", "page_text")
    return e.join(p, "product_id").filter(F.contains("page_text", F.trim("value"))).select("record_id", "attribute_name", "value").distinct()


F5_SQL = "WITH e AS (SELECT record_id, product_id, unnest(map_keys(expected_attributes)) AS attribute_name, unnest(map_values(expected_attributes)) AS value FROM expected_products) SELECT DISTINCT record_id, attribute_name, value FROM e JOIN source_context USING (product_id) WHERE trim(value) <> '' AND contains(page_text, trim(value))"


def F9_authoritative_hosts(spark, sf_dir):
    """The hosts of pages with whether they are market places."""
    h = _pages(spark, sf_dir).select(urls.host(F.col("canonical_product_url")).alias("host")).filter("host is not null").distinct()
    return h.select("host", F.col("host").rlike("|".join(MARKETPLACES)).alias("non_authoritative"))


F9_SQL = f"SELECT DISTINCT host, regexp_matches(host, '{'|'.join(MARKETPLACES)}') AS non_authoritative FROM (SELECT {_HOST.format(c='canonical_product_url')} AS host FROM source_context) WHERE host IS NOT NULL"


def F19_header_coverage(spark, sf_dir):
    """Attribute names against the rule table's labels: the same name, one that begins with it, or another."""
    names = _feeds(spark, sf_dir).select(F.explode(F.map_keys("expected_attributes")).alias("header")).distinct()
    labels = table(spark, sf_dir, "lov_rules").select("attribute_label").distinct()
    cover = F.broadcast(labels.agg(F.collect_set("attribute_label").alias("l")))
    found = F.when(F.array_contains("l", F.col("header")), "exact").when(F.exists("l", lambda x: F.startswith(F.col("header"), x) | F.startswith(x, F.col("header"))), "prefix").otherwise("other")
    return names.join(cover).select("header", found.alias("coverage"))


F19_SQL = "WITH n AS (SELECT DISTINCT unnest(map_keys(expected_attributes)) AS header FROM expected_products) SELECT header, CASE WHEN EXISTS (SELECT 1 FROM lov_rules WHERE attribute_label = header) THEN 'exact' WHEN EXISTS (SELECT 1 FROM lov_rules WHERE starts_with(header, attribute_label) OR starts_with(attribute_label, header)) THEN 'prefix' ELSE 'other' END AS coverage FROM n"


def F22_meaningful(spark, sf_dir):
    """Whether a golden record says more than what a page says about itself."""
    return _feeds(spark, sf_dir).select("record_id", F.coalesce(F.exists(F.map_keys("expected_attributes"), lambda k: ~F.lower(F.trim(k)).isin(GENERIC)), F.lit(False)).alias("meaningful"))


F22_SQL = f"SELECT record_id, coalesce(len(list_filter(map_keys(expected_attributes), lambda k: lower(trim(k)) NOT IN {tuple(GENERIC)})) > 0, FALSE) AS meaningful FROM expected_products"


def _votes(spark, sf_dir):
    return _feeds(spark, sf_dir).filter("product_id is not null")


def X3_shared_records(spark, sf_dir):
    """Products whose records of the maker's page and of other feeds meet in an attribute: the names both have."""
    names = F.map_keys("expected_attributes")
    side = lambda cond, a: _votes(spark, sf_dir).filter(cond).select("product_id", F.explode(names).alias("n")).groupBy("product_id").agg(F.collect_set("n").alias(a))
    both = side("source_feed = 'maker_page'", "a").join(side("source_feed != 'maker_page'", "b"), "product_id")
    return both.select("product_id", F.array_join(F.array_sort(F.array_intersect("a", "b")), ",").alias("shared")).filter("shared != ''")


X3_SQL = "WITH n AS (SELECT DISTINCT product_id, source_feed = 'maker_page' AS own, unnest(map_keys(expected_attributes)) AS n FROM expected_products WHERE product_id IS NOT NULL AND source_feed IS NOT NULL) SELECT a.product_id, array_to_string(list_sort(list(a.n)), ',') AS shared FROM n a JOIN n b ON a.product_id = b.product_id AND a.n = b.n AND a.own AND NOT b.own GROUP BY 1"


def X7_first_reviews(spark, sf_dir):
    """Of values in review the first of each product, attribute and reason."""
    e = _feeds(spark, sf_dir).select("record_id", "product_id", F.explode("expected_attributes").alias("attribute_name", "value"))
    reason = F.when(~delivery.filled("value"), "missing_value").when(~F.col("value").rlike("[0-9]"), "no_number")
    return e.withColumn("reason", reason).filter("reason is not null").groupBy("product_id", "attribute_name", "reason").agg(F.min("record_id").alias("record_id"))


X7_SQL = "WITH e AS (SELECT record_id, product_id, unnest(map_keys(expected_attributes)) AS attribute_name, unnest(map_values(expected_attributes)) AS value FROM expected_products), r AS (SELECT *, CASE WHEN coalesce(trim(value), '') = '' THEN 'missing_value' WHEN NOT regexp_matches(value, '[0-9]') THEN 'no_number' END AS reason FROM e) SELECT product_id, attribute_name, reason, min(record_id) AS record_id FROM r WHERE reason IS NOT NULL GROUP BY 1, 2, 3"


def X10_within_labels(spark, sf_dir):
    """Whether all attributes of a record are labels of the rule table, and those that are not."""
    labels = F.broadcast(table(spark, sf_dir, "lov_rules").agg(F.collect_set("attribute_label").alias("l")))
    extra = F.array_except(F.map_keys("expected_attributes"), F.col("l"))
    e = _feeds(spark, sf_dir).filter("expected_attributes is not null").join(labels)
    return e.select("record_id", (F.size(extra) == 0).alias("within"), F.array_join(F.array_sort(extra), ",").alias("extra"))


X10_SQL = "WITH k AS (SELECT record_id, unnest(map_keys(expected_attributes)) AS k FROM expected_products WHERE len(map_keys(expected_attributes)) > 0), x AS (SELECT record_id, k FROM k ANTI JOIN lov_rules ON k = attribute_label) SELECT e.record_id, count(x.k) = 0 AS within, coalesce(string_agg(x.k, ',' ORDER BY x.k), '') AS extra FROM expected_products e LEFT JOIN x USING (record_id) WHERE expected_attributes IS NOT NULL GROUP BY 1"


def U16_images(spark, sf_dir):
    """The images of each page that are no logo, icon or banner, scored by what their address says, best first: PRIMARY and ALTERNATE."""
    return delivery.ranked_images(_pages(spark, sf_dir).select("context_id", "mpn", "image_urls"), "context_id", "image_urls", "mpn")


U16_SQL = r"""
WITH u AS (SELECT context_id, lower(trim(mpn)) AS mpn, unnest(image_urls) AS url, generate_subscripts(image_urls, 1) AS o FROM source_context),
f AS (SELECT context_id, url, min(o) AS o, max(CASE WHEN mpn <> '' AND contains(lower(url), mpn) THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(url), 'main|primary|hero|front') THEN 1 ELSE 0 END) AS score FROM u WHERE url IS NOT NULL AND NOT regexp_matches(lower(url), 'logo|icon|sprite|banner|social|facebook|twitter|placeholder|avatar|badge') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY score DESC, o) AS place FROM f)
SELECT context_id, url, CAST(place AS INTEGER) AS place, CASE WHEN place = 1 THEN 'PRIMARY' ELSE 'ALTERNATE' END AS role FROM r
"""


def U21_joined_urls(spark, sf_dir):
    """Links as pages write them, made whole against the page's address."""
    p = _pages(spark, sf_dir).filter("canonical_product_url is not null").select("context_id", F.col("canonical_product_url").alias("base"))
    forms = F.array(F.lit("/img/a.jpg"), F.lit("b.pdf"), F.lit("../c?d=1"), F.lit("?e=2"), F.lit("//cdn.example/f.js"), F.lit("https://other.example/g"), F.lit("mailto:x@y.example"))
    return p.select("context_id", "base", F.posexplode(forms).alias("place", "link")).select("context_id", "place", urls.joined(F.col("base"), F.col("link")).alias("url"))


def J25_point_lookups(spark, sf_dir):
    """First value under each name apart from case, as maps are asked."""
    first = lambda name: F.try_element_at(F.transform(F.filter(F.map_entries("expected_attributes"), lambda e: F.lower(e["key"]) == name.lower()), lambda e: e["value"]), F.lit(1))
    return _feeds(spark, sf_dir).select("record_id", first("diameter").alias("diameter"), first("no load speed").alias("no_load_speed"))


J25_SQL = "SELECT record_id, list_filter(map_entries(expected_attributes), lambda e: lower(e.key) = 'diameter')[1].value AS diameter, list_filter(map_entries(expected_attributes), lambda e: lower(e.key) = 'no load speed')[1].value AS no_load_speed FROM expected_products"


def F10_hosts_within(spark, sf_dir):
    """Delivered maker addresses whose host is that of a page of the product, or lies under it."""
    r = rows(spark, sf_dir).select("row_id", "product_id", urls.host(F.col("mfr_url")).alias("h")).filter("h is not null")
    p = _pages(spark, sf_dir).select("product_id", urls.host(F.col("canonical_product_url")).alias("d")).filter("d is not null").distinct()
    return r.join(p, "product_id").groupBy("row_id").agg(F.max(urls.within(F.col("h"), F.col("d"))).alias("within"))


F10_SQL = f"WITH r AS (SELECT row_id, product_id, {_HOST.format(c='mfr_url')} AS h FROM delivery_rows), p AS (SELECT DISTINCT product_id, {_HOST.format(c='canonical_product_url')} AS d FROM source_context) SELECT row_id, bool_or(h = d OR ends_with(h, '.' || d)) AS within FROM r JOIN p USING (product_id) WHERE h IS NOT NULL AND d IS NOT NULL GROUP BY 1"


def C23_authority_ranks(spark, sf_dir):
    """Pages by the weight of their source's word."""
    return _pages(spark, sf_dir).groupBy("source_authority", evidence.authority_rank(F.col("source_authority")).alias("rank")).agg(F.count(F.lit(1)).alias("n_pages"))


C23_SQL = "SELECT source_authority, CAST(coalesce(list_position(['AUTHORITATIVE', 'HIGH', 'MANUFACTURER_PAGE', 'AUTHORIZED_DISTRIBUTOR', 'SECONDARY', 'UNKNOWN'], upper(trim(source_authority))) - 1, -1) AS INTEGER) AS rank, count(*) AS n_pages FROM source_context GROUP BY 1, 2"


def C35_tolerant_payloads(spark, sf_dir):
    """Which trace payloads hold a whole JSON text, also behind a fence or other text."""
    t = table(spark, sf_dir, "trace_runs").filter("payload is not null")
    fenced = t.select("run_id", F.concat(F.lit("Here it is:\n```json\n"), "payload", F.lit("\n```\n")).alias("payload"))
    bare = nested.parsed(t, "run_id", "payload").select(F.col("_key").alias("run_id"), F.lit("bare").alias("form"))
    inside = nested.parsed(fenced.withColumn("payload", text.unfenced(F.col("payload"))), "run_id", "payload").select(F.col("_key").alias("run_id"), F.lit("fenced").alias("form"))
    return bare.unionByName(inside).groupBy("form").agg(F.count(F.lit(1)).alias("n_whole"))


C35_SQL = "WITH v AS (SELECT count(*) AS n FROM (SELECT CAST(ltrim(payload, chr(65279)) AS VARCHAR) AS j FROM trace_runs) WHERE json_valid(j) AND json_type(j) IN ('OBJECT', 'ARRAY')) SELECT 'bare' AS form, n AS n_whole FROM v UNION ALL SELECT 'fenced', n FROM v"

_PAIRS = [
    (P1_delivery_record, P1_SQL), (P2_raw_projection, P2_SQL), (J3_brand_of_maker, J3_SQL), (J9_category_rules, J9_SQL), (J8_allowed_for, J8_SQL), (J13_resolved_makers, J13_SQL), (A3_availability, A3_SQL), (A5_operation_counts, A5_SQL),
    (A8_category_rates, A8_SQL), (A10_enrichment, A10_SQL), (C24_attribute_ids, C24_SQL), (C25_best_values, C25_SQL), (T5_documents_in_order, T5_SQL), (T7_term_presence, T7_SQL), (T9_first_rows, T9_SQL), (T11_profile_rows, T11_SQL), (W8_new_makers, W8_SQL),
    (F3_rows_of_maker, F3_SQL), (F4_quotable, F4_SQL), (F5_verified, F5_SQL), (F9_authoritative_hosts, F9_SQL), (F19_header_coverage, F19_SQL), (F22_meaningful, F22_SQL), (X3_shared_records, X3_SQL), (X7_first_reviews, X7_SQL), (X10_within_labels, X10_SQL),
    (U16_images, U16_SQL), (U21_joined_urls, None), (J25_point_lookups, J25_SQL), (F10_hosts_within, F10_SQL), (C23_authority_ranks, C23_SQL), (C35_tolerant_payloads, C35_SQL),
]
QUERIES = {f.__name__: f for f, _ in _PAIRS}
SQL = {f.__name__: s for f, s in _PAIRS if s}
