"""Named queries of the text operators with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partwright.llm import canonical, leakage, mainbody, packing, residue, subjects, truncation
from partwright.session import table

NAME_FIELDS = {"part_manuf": "MANUFACTURER", "e1_brand": "BRAND", "unilog_brand": "BRAND", "dib_brand": "BRAND"}


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(
        table(spark, sf_dir, "delivery_rows"), "row_id", "feed_source", "part_desc", {"invoice_desc": False, "mobile_desc": True}, "short_desc", "mfg_part_num"
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).filter("is_cut").select("row_id", "field_name")


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts each field."""
    return _judged(spark, sf_dir).groupBy("feed_source", "field_name").agg(
        F.count(F.lit(1)).alias("n_values"), F.sum(F.col("is_cut").cast("bigint")).alias("n_cut"), F.round(F.avg(F.col("is_cut").cast("double")), 6).alias("share_cut")
    )


def p2_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What told the cut values of each field: a structural sign, another field of the record, or only the missing terminator."""
    told = F.when(F.col("broken"), "structure").when(F.col("cut"), "other field").otherwise("terminator")
    return _judged(spark, sf_dir).filter("is_cut").groupBy("field_name", told.alias("evidence")).agg(F.count(F.lit(1)).alias("n_values"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.map_names(table(spark, sf_dir, "delivery_rows"), "row_id", NAME_FIELDS, table(spark, sf_dir, "registry_records"))


def p5_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per field whose name has no entry."""
    found = p5_found(spark, sf_dir)
    return found.groupBy("field_name").agg(F.count(F.lit(1)).alias("n_names"), F.sum((F.col("canonical_id") == canonical.UNMATCHED).cast("bigint")).alias("n_unmatched"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find_residue(
        [
            (table(spark, sf_dir, "delivery_rows"), "delivery_rows", "row_id", {"unilog_brand": False, "dib_brand": False}),
            (table(spark, sf_dir, "source_context"), "source_context", "context_id", {"page_title": True}),
        ]
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = mainbody.main_lines(table(spark, sf_dir, "source_context"), "context_id", "page_text", "canonical_product_url", "page_title")
    return lines.filter("p_main > 0.5").select("context_id", "line_no")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leakage.find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")
    return found.filter(F.col("n_words") >= leakage.MIN_WORDS)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each leaked item was found in, and the most words of it that one carries."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("n_words").alias("most_words"))


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = {r["pack_id"]: r["capacity_tokens"] for r in table(spark, sf_dir, "pack_sizes").collect()}
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", sizes)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_rates(p8_pack(spark, sf_dir), table(spark, sf_dir, "pack_sizes"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.document_subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"), table(spark, sf_dir, "subject_areas"))


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The make-up of the corpus: documents of each subject and their share."""
    found, names = p10_found(spark, sf_dir), table(spark, sf_dir, "subject_areas").select("subject_id", "subject_name")
    total = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_all"))
    counted = found.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_documents"))
    return names.join(counted, "subject_id", "left").join(F.broadcast(total)).select(
        "subject_id", "subject_name", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.round(F.coalesce("n_documents", F.lit(0)) / F.col("n_all"), 6).alias("share_of_documents")
    )


_QUERIES = (p2_found, p2_rates, p2_evidence, p5_found, p5_unmatched, p6_found, p7_found, p8_pack, p8_fill, p9_found, p9_items, p10_found, p10_composition)
_SQL: dict[str, str] = {}


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
