"""Named queries: profiles, normalisation, duplicates, keys, numbers, addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partwright.functions import identifiers, numbers, text, urls
from partwright.operators import profile
from partwright.session import table

RAW = ["mfg_part_num", "part_desc", "e1_brand", "unilog_brand", "dib_brand", "part_manuf"]
_PLACE = "('-- Unbranded --', '-- No Unilog Brand --', '-- No DIB Brand --')"
_STRIP = r"regexp_replace({c}, '^[\s ]+|[\s ]+$', '', 'g')"
_KEY = r"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
_COLLAPSE = r"trim(regexp_replace({c}, '[\s ]+', ' ', 'g'))"


def _strip(c: str) -> str:
    return _STRIP.format(c=c)


def _long(columns: list[str], *keep: str) -> str:
    head = "".join(f"{k}, " for k in keep)
    return " UNION ALL ".join(f"SELECT {head}'{c}' AS column_name, {c} AS value FROM delivery_rows" for c in columns)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "delivery_rows")


def A1_profile(spark, sf_dir):
    return profile.profile(rows(spark, sf_dir), [*RAW, "row_number", "classpath"])


A1_SQL = f"""
WITH v AS ({_long([*RAW, "classpath"])} UNION ALL SELECT 'row_number', CAST(row_number AS VARCHAR) FROM delivery_rows),
t AS (SELECT *, {_strip('value')} AS s FROM v),
k AS (SELECT *, CASE WHEN value IS NULL OR s = '' THEN NULL WHEN lower(s) IN ('true', 'false') THEN 'bool' WHEN regexp_matches(s, '^\\d{{4}}-\\d{{2}}-\\d{{2}}([ T].*)?$') THEN 'date'
  WHEN regexp_matches(s, '^[+-]?\\d+$') THEN 'int' WHEN regexp_matches(s, '^[+-]?(\\d+\\.\\d*|\\.\\d+|\\d+)([eE][+-]?\\d+)?$') THEN 'float' ELSE 'string' END AS ty FROM t)
SELECT column_name, count(*) AS n_rows, count(*) FILTER (value IS NULL) AS n_null, count(*) FILTER (s = '') AS n_blank,
  count(*) FILTER (s IN {_PLACE}) AS n_placeholder, count(DISTINCT value) AS n_distinct, coalesce(array_to_string(list_sort(list(DISTINCT ty) FILTER (ty IS NOT NULL)), ','), '') AS types
FROM k GROUP BY 1
"""


def A2_representatives(spark, sf_dir):
    return profile.representatives(rows(spark, sf_dir), RAW, "row_id")


A2_SQL = f"""
WITH s AS (SELECT column_name, value, min(row_id) AS f FROM ({_long(RAW, 'row_id')}) WHERE value IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY f, value) AS place FROM s)
SELECT column_name, CAST(place AS INTEGER) AS place, value FROM r WHERE place <= 5
"""


def A4_mpn_duplicates(spark, sf_dir):
    return profile.duplicate_groups(rows(spark, sf_dir), "mfg_part_num")


A4_SQL = f"SELECT upper({_strip('mfg_part_num')}) AS value, count(*) AS n_rows FROM delivery_rows WHERE {_strip('mfg_part_num')} <> '' GROUP BY 1 HAVING count(*) > 1"


def A4_placeholder_counts(spark, sf_dir):
    return profile.cells(rows(spark, sf_dir), RAW).filter(text.strip(F.col("value")).isin(text.PLACEHOLDERS)).groupBy("column_name").agg(F.count(F.lit(1)).alias("n_placeholder"))


A4P_SQL = f"SELECT column_name, count(*) AS n_placeholder FROM ({_long(RAW)}) WHERE {_strip('value')} IN {_PLACE} GROUP BY 1"


def F1_normalize(spark, sf_dir):
    return profile.cells(rows(spark, sf_dir), RAW, "row_id").select("row_id", "column_name", text.normalized(F.col("value")).alias("n")).select("row_id", "column_name", "n.normalized", "n.reason")


F1_SQL = f"""
WITH v AS (SELECT *, {_strip('value')} AS s FROM ({_long(RAW, 'row_id')}))
SELECT row_id, column_name, CASE WHEN value IS NULL OR s = '' OR s IN {_PLACE} THEN NULL ELSE s END AS normalized,
  CASE WHEN value IS NULL THEN 'null' WHEN s = '' THEN 'blank' WHEN s IN {_PLACE} THEN 'placeholder' WHEN s <> value THEN 'trimmed' END AS reason FROM v
"""

_CONTENT = ["product_id", "feed_source", "dealer_account", "mfr_url", *RAW, "classpath", "mobile_desc", "invoice_desc", "short_desc"]
_HASH = "sha256(concat_ws(chr(31), " + ", ".join(f"coalesce({c}, '')" for c in _CONTENT) + "))"


def S7_row_hash(spark, sf_dir):
    return rows(spark, sf_dir).select("row_id", identifiers.row_hash(*[F.col(c) for c in _CONTENT]).alias("row_hash"))


S7_SQL = f"SELECT row_id, {_HASH} AS row_hash FROM delivery_rows"


def X4_resent_rows(spark, sf_dir):
    return profile.resent(rows(spark, sf_dir), "row_id", _CONTENT)


X4_SQL = f"WITH h AS (SELECT row_id, {_HASH} AS row_hash FROM delivery_rows), f AS (SELECT row_hash, min(row_id) AS first_key FROM h GROUP BY 1) SELECT row_id, first_key, row_hash FROM h JOIN f USING (row_hash) WHERE row_id > first_key"


def S5_unique_headers(spark, sf_dir):
    """The rule table's labels as the header of one sheet, every third one left blank, made usable."""
    labels = table(spark, sf_dir, "lov_rules").select("rule_id", F.when(F.col("rule_id") % 3 != 0, F.col("attribute_label")).alias("h")).orderBy("rule_id").collect()
    names = profile.unique_headers([r["h"] for r in labels])
    return spark.createDataFrame([(r["rule_id"], n) for r, n in zip(labels, names)], "rule_id int, name string")


S5_SQL = "WITH h AS (SELECT rule_id, CASE WHEN rule_id % 3 <> 0 THEN trim(attribute_label) ELSE '__unnamed_' || row_number() OVER (ORDER BY rule_id) END AS h FROM lov_rules), k AS (SELECT rule_id, h, row_number() OVER (PARTITION BY h ORDER BY rule_id) AS k FROM h) SELECT rule_id, CASE WHEN k = 1 THEN h ELSE h || '#' || k END AS name FROM k"


def C1_normalize_text(spark, sf_dir):
    d = F.col("part_desc")
    return rows(spark, sf_dir).filter("part_desc is not null").select("row_id", text.collapse(d).alias("collapsed"), text.canonical_key(d).alias("canonical"), F.upper(text.collapse(F.col("mfg_part_num"))).alias("part_number"))


C1_SQL = f"SELECT row_id, {_COLLAPSE.format(c='part_desc')} AS collapsed, {_KEY.format(c='part_desc')} AS canonical, upper({_COLLAPSE.format(c='mfg_part_num')}) AS part_number FROM delivery_rows WHERE part_desc IS NOT NULL"


def C4_mpn_hypotheses(spark, sf_dir):
    h = identifiers.mpn_hypotheses(F.col("mfg_part_num"), F.col("part_manuf"))
    return rows(spark, sf_dir).select("row_id", F.posexplode(h).alias("at", "h")).select("row_id", (F.col("at") + 1).alias("place"), "h.*")


C4_SQL = r"""
WITH m AS (SELECT row_id, regexp_replace(mfg_part_num, '^\s+|\s+$', '', 'g') AS raw, regexp_matches(lower(coalesce(part_manuf, '')), '3m|jam industrial') AS known FROM delivery_rows),
b AS (SELECT *, regexp_replace(raw, '[-_\s/.]+', '', 'g') AS bare, regexp_extract(raw, '^([A-Za-z0-9]{2,6})[-_]([A-Za-z0-9._/-]+)$', 1) AS head, regexp_extract(raw, '^([A-Za-z0-9]{2,6})[-_]([A-Za-z0-9._/-]+)$', 2) AS tail FROM m WHERE raw <> ''),
p AS (SELECT *, known AND (starts_with(upper(head), '3M') OR regexp_matches(tail, '^\d{8,10}$')) AS prefixed, regexp_replace(tail, '[-_\s/.]+', '', 'g') AS bare_tail FROM b),
u AS (SELECT row_id, 1 AS o, 0 AS i, raw AS value, 'raw' AS kind, 1.0 AS confidence, TRUE AS lossless, TRUE AS identity_eligible, 'raw_input' AS rule FROM p
  UNION ALL SELECT row_id, 2, 0, bare, 'lossless_normalized', 0.98, TRUE, TRUE, 'lossless_separator_removal' FROM p WHERE length(bare) >= 3 AND bare <> raw
  UNION ALL SELECT row_id, 3, 0, tail, CASE WHEN prefixed THEN 'verified_manufacturer_transform' ELSE 'exploratory_prefix_strip' END, CASE WHEN prefixed THEN 0.9 ELSE 0.5 END, FALSE, prefixed, CASE WHEN prefixed THEN 'known_3m_distributor_prefix' ELSE 'generic_prefix_strip' END FROM p WHERE length(tail) >= 3
  UNION ALL SELECT row_id, 4, i, d, CASE WHEN known THEN 'verified_manufacturer_transform' ELSE 'exploratory_numeric_extraction' END, CASE WHEN known THEN 0.9 ELSE 0.4 END, FALSE, known, CASE WHEN known THEN 'known_3m_numeric_id' ELSE 'generic_numeric_core' END
    FROM (SELECT row_id, known, unnest(regexp_extract_all(raw, '\b(\d{8,10})\b', 1)) AS d, generate_subscripts(regexp_extract_all(raw, '\b(\d{8,10})\b', 1), 1) AS i FROM p)
  UNION ALL SELECT row_id, 5, 0, bare_tail, 'exploratory_compact', 0.35, FALSE, FALSE, 'exploratory_compact' FROM p WHERE regexp_matches(tail, '[-_\s/.]') AND length(bare_tail) >= 3),
f AS (SELECT *, row_number() OVER (PARTITION BY row_id, lower(value) ORDER BY o, i) AS r FROM u)
SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY o, i) AS INTEGER) AS place, value, kind, CAST(confidence AS DOUBLE) AS confidence, lossless, identity_eligible, rule FROM f WHERE r = 1
"""


def C5_code_suffix(spark, sf_dir):
    m = F.col("part_manuf")
    return rows(spark, sf_dir).filter("part_manuf is not null").select("row_id", text.code_suffix(m).alias("code"), text.without_code(m).alias("name"))


C5_SQL = r"SELECT row_id, nullif(regexp_extract(part_manuf, '\(([A-Za-z0-9-]+)\)\s*$', 1), '') AS code, regexp_replace(regexp_replace(part_manuf, '\s*\([A-Za-z0-9-]+\)\s*$', ''), '^[\s ]+|[\s ]+$', '', 'g') AS name FROM delivery_rows WHERE part_manuf IS NOT NULL"


def C7_identity_key(spark, sf_dir):
    return table(spark, sf_dir, "registry_records").select("record_id", text.identity_key(F.col("canonical_name")).alias("identity_key"))


C7_SQL = "SELECT record_id, regexp_replace(lower(canonical_name), '[^a-z0-9]', '', 'g') AS identity_key FROM registry_records"


def C10_title_overlap(spark, sf_dir):
    t = table(spark, sf_dir, "source_context").filter("page_title is not null")
    return t.select("context_id", F.round(text.overlap_share(F.col("page_title"), F.coalesce("page_text", F.lit(""))), 4).alias("share"))


C10_SQL = f"""
WITH w AS (SELECT context_id, coalesce(page_text, '') AS t, list_distinct(list_filter(string_split({_KEY.format(c='page_title')}, ' '), lambda x: length(x) >= 4)) AS w FROM source_context WHERE page_title IS NOT NULL)
SELECT context_id, CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: contains(lower(t), x))) / len(w), 4) ELSE 0.0 END AS share FROM w
"""


def C11_mpn_match(spark, sf_dir):
    """How the part number of a product's page compares with the one delivered."""
    d = rows(spark, sf_dir).groupBy("product_id").agg(F.min("mfg_part_num").alias("delivered"))
    p = table(spark, sf_dir, "source_context").select("context_id", "product_id", "mpn")
    return p.join(d, "product_id").select("context_id", text.mpn_match(F.col("mpn"), F.col("delivered")).alias("mpn_match"))


C11_SQL = f"""
WITH d AS (SELECT product_id, min(mfg_part_num) AS delivered FROM delivery_rows GROUP BY 1),
j AS (SELECT context_id, mpn, delivered, regexp_replace(lower(mpn), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS x, regexp_replace(lower(delivered), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS y FROM source_context JOIN d USING (product_id))
SELECT context_id, CASE WHEN mpn IS NULL OR delivered IS NULL OR x = '' OR y = '' THEN 'MISSING' WHEN {_strip('mpn')} = {_strip('delivered')} THEN 'EXACT' WHEN x = y THEN 'NORMALIZED_EQUIVALENT' ELSE 'DIFFERENT' END AS mpn_match FROM j
"""


def C12_classpath_depth(spark, sf_dir):
    n = table(spark, sf_dir, "lov_rules").select("rule_id", F.array_join("classpath_nodes", " > ").alias("p"))
    parts = F.filter(F.split("p", ">"), lambda x: F.trim(x) != "")
    return n.select("rule_id", F.size(parts).cast("bigint").alias("depth"))


C12_SQL = "SELECT rule_id, len(list_filter(string_split(array_to_string(classpath_nodes, ' > '), '>'), lambda x: trim(x) <> '')) AS depth FROM lov_rules"


def C13_value_and_unit(spark, sf_dir):
    e = table(spark, sf_dir, "expected_products").select("record_id", F.explode("expected_attributes").alias("attribute_name", "raw")).filter("raw is not null")
    return e.select("record_id", "attribute_name", numbers.value_and_unit(F.col("raw")).alias("v")).select("record_id", "attribute_name", "v.value", "v.unit")


C13_SQL = r"""
WITH e AS (SELECT record_id, unnest(map_keys(expected_attributes)) AS attribute_name, unnest(map_values(expected_attributes)) AS raw FROM expected_products),
x AS (SELECT *, regexp_extract(raw, '^\s*([0-9]+(?:\.[0-9]+)?(?:-[0-9]+/[0-9]+)?|[0-9]+/[0-9]+)\s*([A-Za-z"''°%][A-Za-z0-9"''°%/]*)\.?\s*$', 1) AS v,
  regexp_extract(raw, '^\s*([0-9]+(?:\.[0-9]+)?(?:-[0-9]+/[0-9]+)?|[0-9]+/[0-9]+)\s*([A-Za-z"''°%][A-Za-z0-9"''°%/]*)\.?\s*$', 2) AS u FROM e WHERE raw IS NOT NULL)
SELECT record_id, attribute_name, CASE WHEN v <> '' THEN v ELSE trim(raw) END AS value, nullif(u, '') AS unit FROM x
"""


def C20_numbers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    n = text.numbers_in(F.col("text"))
    return d.select("doc_id", F.size(n).cast("bigint").alias("n_numbers"), F.array_join(n, " ").alias("numbers"))


C20_SQL = r"WITH n AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '([0-9]),([0-9]{3})', '\1\2', 'g'), '[0-9]+(?:\.[0-9]+)?') AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(n) AS n_numbers, array_to_string(n, ' ') AS numbers FROM n"


def C29_fingerprint(spark, sf_dir):
    return rows(spark, sf_dir).select("row_id", identifiers.fingerprint(F.lower("product_id"), F.col("mfg_part_num"), F.col("feed_source")).alias("cache_key"))


C29_SQL = "SELECT row_id, sha256(concat_ws('|', coalesce(lower(product_id), ''), coalesce(mfg_part_num, ''), coalesce(feed_source, ''))) AS cache_key FROM delivery_rows"


def C30_context_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", text.context_tokens(F.col("text")).alias("n_tokens"))


C30_SQL = "SELECT doc_id, greatest(1, (length(text) + 3) // 4) AS n_tokens FROM documents WHERE text IS NOT NULL"


def M1_fractions(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") % 16).alias("x"))
    return p.select("p_partkey", numbers.double_to_fraction(F.round("x", 4)).alias("fraction"))


M1_SQL = """
WITH p AS (SELECT p_partkey, round(p_retailprice % 16, 4) AS x FROM part), r AS (SELECT p_partkey, x, floor(x) AS w, x - floor(x) AS f FROM p),
c AS (SELECT p_partkey, w, d, abs(f - round(f * d) / d) AS off, CAST(round(f * d) AS INTEGER) AS n FROM r, range(1, 65) t(d)),
b AS (SELECT p_partkey, w, d, n, row_number() OVER (PARTITION BY p_partkey ORDER BY off, d, n) AS k FROM c)
SELECT p_partkey, CASE WHEN n = d THEN CAST(CAST(w + 1 AS BIGINT) AS VARCHAR) WHEN n = 0 THEN CAST(CAST(w AS BIGINT) AS VARCHAR) WHEN w = 0 THEN n || '/' || d ELSE CAST(CAST(w AS BIGINT) AS VARCHAR) || '-' || n || '/' || d END AS fraction FROM b WHERE k = 1
"""


def M2_decimals(spark, sf_dir):
    e = table(spark, sf_dir, "expected_products").select("record_id", F.explode("expected_attributes").alias("attribute_name", "raw"))
    n = F.regexp_extract("raw", r"^\s*([0-9]+(?:[- ][0-9]+)?/[0-9]+|[0-9]+(?:\.[0-9]+)?)", 1)
    return e.select("record_id", "attribute_name", F.round(numbers.fraction_to_double(n), 6).alias("number")).filter("number is not null")


M2_SQL = r"""
WITH e AS (SELECT record_id, unnest(map_keys(expected_attributes)) AS attribute_name, unnest(map_values(expected_attributes)) AS raw FROM expected_products),
n AS (SELECT record_id, attribute_name, regexp_extract(raw, '^\s*([0-9]+(?:[- ][0-9]+)?/[0-9]+|[0-9]+(?:\.[0-9]+)?)', 1) AS n FROM e),
p AS (SELECT *, regexp_extract(n, '^(?:([0-9]+)[- ])?([0-9]+)/([0-9]+)$', 1) AS w, regexp_extract(n, '^(?:([0-9]+)[- ])?([0-9]+)/([0-9]+)$', 2) AS a, regexp_extract(n, '^(?:([0-9]+)[- ])?([0-9]+)/([0-9]+)$', 3) AS b FROM n)
SELECT record_id, attribute_name, round(CASE WHEN b <> '' THEN coalesce(TRY_CAST(nullif(w, '') AS DOUBLE), 0) + TRY_CAST(a AS DOUBLE) / nullif(TRY_CAST(b AS DOUBLE), 0) ELSE TRY_CAST(n AS DOUBLE) END, 6) AS number
FROM p WHERE n <> '' AND (b = '' OR TRY_CAST(b AS DOUBLE) <> 0)
"""


def U1_url_canonical(spark, sf_dir):
    u = F.concat(F.col("canonical_product_url"), F.lit("?utm_source=x&ref=7&fbclid=1#top"))
    return table(spark, sf_dir, "source_context").filter("canonical_product_url is not null").select("context_id", urls.canonical(u).alias("url"), urls.host(F.col("canonical_product_url")).alias("host"))


U1_SQL = r"""
WITH u AS (SELECT context_id, canonical_product_url AS r, trim(canonical_product_url) || '?utm_source=x&ref=7&fbclid=1#top' AS u FROM source_context WHERE canonical_product_url IS NOT NULL),
p AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:]+:(\d+)', 1) AS port, nullif(regexp_replace(regexp_extract(lower(u), '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1), '\.$', ''), '') AS h,
  regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, array_to_string(list_filter(string_split(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|fbclid|gclid)(=|$)')), '&') AS q FROM u)
SELECT context_id, CASE WHEN s IN ('http', 'https') AND h IS NOT NULL THEN s || '://' || h || CASE WHEN port = '' OR (s = 'http' AND port = '80') OR (s = 'https' AND port = '443') THEN '' ELSE ':' || port END || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS url,
  nullif(regexp_replace(regexp_extract(lower(trim(r)), '^[a-z][a-z0-9+.-]*://([^/?#:]+)', 1), '\.$', ''), '') AS host FROM p
"""


def F18_search(spark, sf_dir):
    r = rows(spark, sf_dir)
    return r.filter(F.contains(F.lower(F.concat_ws(" ", *[F.col(c) for c in RAW])), F.lit("nail gun"))).select("row_id", "product_id")


F18_SQL = "SELECT row_id, product_id FROM delivery_rows WHERE contains(lower(concat_ws(' ', " + ", ".join(RAW) + ")), 'nail gun')"


def A6_makers(spark, sf_dir):
    return rows(spark, sf_dir).filter("trim(part_manuf) != ''").groupBy(F.lower(F.trim("part_manuf")).alias("maker")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_id").alias("first_row"))


A6_SQL = "SELECT lower(trim(part_manuf)) AS maker, count(*) AS n_rows, min(row_id) AS first_row FROM delivery_rows WHERE trim(part_manuf) <> '' GROUP BY 1"

_PAIRS = [
    (A1_profile, A1_SQL), (A2_representatives, A2_SQL), (A4_mpn_duplicates, A4_SQL), (A4_placeholder_counts, A4P_SQL), (F1_normalize, F1_SQL), (S7_row_hash, S7_SQL), (X4_resent_rows, X4_SQL),
    (S5_unique_headers, S5_SQL), (C1_normalize_text, C1_SQL), (C4_mpn_hypotheses, C4_SQL), (C5_code_suffix, C5_SQL), (C7_identity_key, C7_SQL), (C10_title_overlap, C10_SQL), (C11_mpn_match, C11_SQL),
    (C12_classpath_depth, C12_SQL), (C13_value_and_unit, C13_SQL), (C20_numbers, C20_SQL), (C29_fingerprint, C29_SQL), (C30_context_tokens, C30_SQL), (M1_fractions, M1_SQL), (M2_decimals, M2_SQL),
    (U1_url_canonical, U1_SQL), (F18_search, F18_SQL), (A6_makers, A6_SQL),
]
QUERIES = {f.__name__: f for f, _ in _PAIRS}
SQL = {f.__name__: s for f, s in _PAIRS}
