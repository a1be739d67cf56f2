"""Named queries for units (problem 1), packed fields (3) and nested records (4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partwright.operators import nested, packed, units
from partwright.session import table


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.measured_values(table(spark, sf_dir, "expected_products"), "record_id", "expected_attributes", "spec_note", "source_feed", "product_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir).filter("unique_solution").select("record_id", "attribute_name", "value_no", "common_value")


def p1_not_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values whose readings tie, which p1_found leaves out."""
    return _values(spark, sf_dir).filter("not unique_solution").select("record_id", "attribute_name", "value_no", "common_value")


_TWICE = r"^[^0-9]*([0-9]+\.?[0-9]*) ?(mm|cm|in|inch|\")\.? ?([\[/(]) ?([0-9]+\.?[0-9]*) ?(mm|cm|in|inch|\")\.?[\])]?$"


def p1_source_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of whole sources by identity: lengths stated twice in one text, first = second, the units as written being left out.

    One source for each feed, the sign between the statements, and which of the two numbers is larger.
    """
    e = table(spark, sf_dir, "expected_products").select("source_feed", F.explode(F.array(*[F.try_element_at("expected_attributes", F.lit(n)) for n in ("Diameter", "Thickness")])).alias("t"))
    part = lambda i: F.regexp_extract("t", _TWICE, i)
    e = e.filter(F.col("t").rlike(_TWICE)).select("source_feed", part(3).alias("sign"), part(1).cast("double").alias("first"), part(4).cast("double").alias("second"))
    e = e.withColumn("source", F.concat_ws(" ", "source_feed", "sign", F.when(F.col("first") > F.col("second"), "falls").otherwise("rises")))
    sizes = {"mm": 1.0, "in": 25.4}
    found = units.resolve_source_units(e, "source", {"first": sizes, "second": sizes}, [{"first": 1, "second": -1}], 0.1)
    return found.select("source", "column", "unit", F.round("log_residual", 4).alias("log_residual"), "unique_solution")


P1_SOURCE_UNITS_SQL = r"""
WITH e AS (SELECT source_feed, unnest([expected_attributes['Diameter'], expected_attributes['Thickness']]) AS t FROM expected_products),
n AS (SELECT source_feed, regexp_extract(t, '{rx}', 3) AS sign, CAST(regexp_extract(t, '{rx}', 1) AS DOUBLE) AS a, CAST(regexp_extract(t, '{rx}', 4) AS DOUBLE) AS b FROM e WHERE regexp_matches(t, '{rx}')),
m AS (SELECT source_feed || ' ' || sign || ' ' || CASE WHEN a > b THEN 'falls' ELSE 'rises' END AS source, avg(CASE WHEN a > 0 AND b > 0 THEN ln(a) - ln(b) END) AS l FROM n GROUP BY 1),
u AS (SELECT * FROM (VALUES ('mm', 1.0), ('in', 25.4)) t(unit, size)),
c AS (SELECT source, x.unit AS ux, y.unit AS uy, abs(l + ln(x.size) - ln(y.size)) AS off FROM m, u x, u y WHERE l IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY off, ux, uy) AS k FROM c), best AS (SELECT * FROM r WHERE k = 1),
j AS (SELECT b.*, bool_and(r.off > b.off + 0.1 OR r.ux = b.ux) AS sx, bool_and(r.off > b.off + 0.1 OR r.uy = b.uy) AS sy FROM best b JOIN r ON r.source = b.source GROUP BY ALL)
SELECT source, 'first' AS "column", ux AS unit, round(off, 4) AS log_residual, sx AS unique_solution FROM j UNION ALL SELECT source, 'second', uy, round(off, 4), sy FROM j
""".replace("{rx}", _TWICE)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = packed.known_names(table(spark, sf_dir, "lov_rules"))
    return packed.split_packed(table(spark, sf_dir, "delivery_rows"), "row_id", "classpath", known)


def p3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The splitting rules themselves: skeleton, values that have it, nodes it gives, delimiters taken."""
    known = packed.known_names(table(spark, sf_dir, "lov_rules"))
    rules = packed.splitting_rules(table(spark, sf_dir, "delivery_rows"), "classpath", known)
    return rules.select(F.replace("skeleton", F.lit("\u0001"), F.lit("")).alias("skeleton"), F.col("values").alias("n_values"), F.size("segments").alias("n_nodes"), F.array_join("delimiters", " ").alias("delimiters"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten_traces(table(spark, sf_dir, "trace_runs")).select("run_id", "trace_no", "child_table", "parent_no", "child_no", "child_value")


def p4_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table with its surrogate keys."""
    flat = nested.flatten_traces(table(spark, sf_dir, "trace_runs")).withColumnRenamed("trace_no", "record_no")
    return nested.child_table(flat, "run_id", "chunk")


def p4_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every list of the traces as a table under its place, with the surrogate keys that link them."""
    flat = nested.flatten_records(table(spark, sf_dir, "trace_runs"), "run_id", "payload", "traces")
    return nested.linked(flat, "run_id")


def p4_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged schema of all whole payloads, one row."""
    docs = nested.parsed(table(spark, sf_dir, "trace_runs"), "run_id", "payload").filter("schema_of_variant(doc) like 'OBJECT%'")
    return docs.agg(F.count(F.lit(1)).alias("n_files"), F.schema_of_variant_agg("doc").alias("merged_schema"))


QUERIES = {f.__name__: f for f in (p1_found, p1_not_unique, p1_source_units, p3_found, p3_rules, p4_found, p4_chunks, p4_tables, p4_schema)}
SQL = {"p1_source_units": P1_SOURCE_UNITS_SQL}
