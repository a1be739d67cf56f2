"""Delivery shapes and measures: slots, ordered links, composed texts, completeness, medians, categories."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partwright.functions import numbers


def filled(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.trim(col), F.lit("")) != ""


def completeness(columns: list[str]) -> Column:
    """The percentage of a row's columns that are filled, rounded half to even."""
    return F.bround(100.0 * sum((filled(c).cast("int") for c in columns), F.lit(0)) / len(columns), 2)


def completeness_by(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Per group and column: rows, filled cells and their percentage; one pass with partial sums."""
    wide = df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(filled(c).cast("bigint")).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_filled")) for c in columns])
    return wide.select(by, "n_rows", F.inline(pairs)).select(by, "column_name", "n_rows", "n_filled", F.round(100.0 * F.col("n_filled") / F.col("n_rows"), 2).alias("pct"))


def upper_median(df: DataFrame, by: str, value: str) -> DataFrame:
    """Per group the element at place n div 2 of the sorted values; counted per distinct value first, nulls left out."""
    per = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(by).orderBy(value))
    total = F.sum("c").over(Window.partitionBy(by))
    return per.withColumn("upto", upto).withColumn("n", total).filter(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(by).agg(F.min(value).alias("upper_median"), F.first("n").alias("n"))


def numbered_attributes(attributes: str) -> Column:
    """The attributes that have a value, in the order written: an array of (place from 1, label, value, uom)."""
    has = F.filter(F.map_entries(attributes), lambda e: e["value"].rlike(r"\S"))
    split = lambda e: numbers.value_and_unit(e["value"])
    return F.transform(has, lambda e, i: F.struct((i + 1).alias("place"), e["key"].alias("label"), split(e)["value"].alias("value"), split(e)["unit"].alias("uom")))


def attribute_slots(df: DataFrame, key: str, attributes: str, slots: int) -> DataFrame:
    """How many attributes a record has, and the first ``slots`` of them as ``label_i`` / ``value_i`` / ``uom_i``."""
    at = lambda i: F.try_element_at(F.col("_a"), F.lit(i))
    count = F.coalesce(F.size("_a"), F.lit(0)).alias("n_attributes")
    a = df.select(key, F.coalesce(numbered_attributes(attributes), F.array()).alias("_a"))
    return a.select(key, count, *[at(i)[c].alias(f"{c}_{i}") for i in range(1, slots + 1) for c in ("label", "value", "uom")])


def beyond_slots(df: DataFrame, key: str, attributes: str, slots: int) -> DataFrame:
    """The attributes for which a record has no slot left, one row each."""
    rest = F.filter(numbered_attributes(attributes), lambda x: x["place"] > slots)
    return df.select(key, F.inline(rest))


def ordered_urls(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The links of several lists in the order of the lists, each once: ``url`` and ``place`` from 1."""
    every = F.array_distinct(F.filter(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in columns]), lambda u: u.isNotNull()))
    return df.select(key, F.posexplode(every).alias("_p", "url")).select(key, "url", (F.col("_p") + 1).alias("place"))


# What a document is, by parts of its address, title and anchor; first match counts.
ASSET_TYPES = [
    ("sds", ["sds", "msds", "safety data sheet", "safety-data-sheet"]),
    ("warranty", ["warranty", "guarantee", "limited warranty"]),
    ("installation_manual", ["install", "installation", "instruction", "setup guide", "mounting", "assembly", "installation manual", "installation instructions"]),
    ("user_manual", ["user manual", "user guide", "owners manual", "owner's manual", "operator manual", "operating instructions"]),
    ("cad_drawing", ["cad", "dwg", "dxf", "step", "stp", "line drawing", "dimensional drawing", "engineering drawing", "blueprint", "diagram", "dimension"]),
    ("catalog", ["catalog", "catalogue", "brochure", "flyer", "pamphlet", "line card", "full line"]),
    ("specification_sheet", ["spec sheet", "specification", "tech sheet", "technical sheet", "datasheet", "data sheet", "cutsheet", "cut sheet", "technical data", "technical bulletin", "submittal", "product data", "tds"]),
]
OTHER_DOCUMENT = "other_document"
# The order in which document links are given, by parts of the address.
DOCUMENT_ORDER = [
    ["manual", "install", "user-guide", "user_guide", "owner", "use-and-care", "instruction", "setup"],
    ["spec", "datasheet", "brochure", "cutsheet", "catalog"],
    ["tech", "wiring", "diagram", "service", "bulletin", "engineering", "drawing"],
    ["warranty", "guarantee"],
    [".pdf", "document", "download", "/pdf"],
]


def _said(url: Column, title: Column | None, anchor: Column | None) -> Column:
    return F.lower(F.concat_ws(" ", url, F.coalesce(title, F.lit("")) if title is not None else F.lit(""), F.coalesce(anchor, F.lit("")) if anchor is not None else F.lit("")))


def _one_of(c: Column, words: list[str]) -> Column:
    return c.rlike("|".join(re.escape(w) for w in words))


def asset_type(url: Column, title: Column | None = None, anchor: Column | None = None) -> Column:
    """What a document is; other_document where nothing tells, null for a null address."""
    said, out = _said(url, title, anchor), F.when(url.isNull(), F.lit(None).cast("string"))
    for name, words in ASSET_TYPES:
        out = out.when(_one_of(said, words), name)
    return out.otherwise(OTHER_DOCUMENT)


def association(url: Column, mpn: Column, title: Column | None = None, catalog: bool = False) -> Column:
    """MANUFACTURER_GENERAL for catalogues and for warranties and full-line papers that do not name the part, else PRODUCT_SPECIFIC."""
    said = _said(url, title, None)
    code = F.lower(F.trim(mpn))
    named = F.contains(said, code) | F.contains(F.regexp_replace(said, "[-_ ]", ""), F.regexp_replace(code, "[- ]", ""))
    general = said.rlike("warranty|full line|general catalog|brochure")
    return F.when(F.lit(catalog), "MANUFACTURER_GENERAL").when(F.coalesce(code, F.lit("")) == "", "PRODUCT_SPECIFIC").when(named | ~general, "PRODUCT_SPECIFIC").otherwise("MANUFACTURER_GENERAL")


def document_rank(url: Column) -> Column:
    """1 for manuals to 6 for anything else, by DOCUMENT_ORDER; .pdf counts at the end of the address only."""
    low = F.lower(url)
    out = None
    for i, words in enumerate(DOCUMENT_ORDER, 1):
        hit = _one_of(low, [w for w in words if w != ".pdf"]) | (F.endswith(low, F.lit(".pdf")) if ".pdf" in words else F.lit(False))
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out.otherwise(len(DOCUMENT_ORDER) + 1)


# Words in the address of an image that shows no product, and of one that shows it whole.
NO_PRODUCT, WHOLE = "logo|icon|sprite|banner|social|facebook|twitter|placeholder|avatar|badge", "main|primary|hero|front"


def ranked_images(df: DataFrame, key: str, images: str, mpn: str) -> DataFrame:
    """The images that may show a product: ``url``, ``place`` and ``role`` (PRIMARY, then ALTERNATE); 2 for the part number in the address, 1 for a whole view, then the order given."""
    u = df.select(key, F.lower(F.trim(mpn)).alias("_m"), F.posexplode(images).alias("_o", "url")).filter(F.col("url").isNotNull() & ~F.lower("url").rlike(NO_PRODUCT))
    score = F.when((F.col("_m") != "") & F.contains(F.lower("url"), F.col("_m")), 2).otherwise(0) + F.when(F.lower("url").rlike(WHOLE), 1).otherwise(0)
    f = u.withColumn("_s", score).groupBy(key, "url").agg(F.min("_o").alias("_o"), F.max("_s").alias("_s"))
    f = f.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_s"), "_o")))
    return f.select(key, "url", "place", F.when(F.col("place") == 1, "PRIMARY").otherwise("ALTERNATE").alias("role"))


def descriptions(df: DataFrame) -> DataFrame:
    """An invoice line of up to 60 capitals and a short text of up to 150 characters, from what a row has."""
    has = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return df.select(
        "row_id",
        F.rtrim(F.substring(F.upper(F.concat_ws(" ", has("part_manuf"), has("mfg_part_num"), has("part_desc"))), 1, 60)).alias("invoice_text"),
        F.rtrim(F.substring(F.concat_ws(", ", has("mfg_part_num"), has("part_desc"), has("classpath")), 1, 150)).alias("short_text"),
    )


def category_counts(df: DataFrame) -> DataFrame:
    """How many rows fall into each category; a row can be in several."""
    repeated = df.filter(filled("mfg_part_num")).groupBy(F.lower("mfg_part_num").alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    tests = {
        "no_mpn": ~filled("mfg_part_num"), "no_description": ~filled("part_desc"), "no_maker": ~filled("part_manuf"), "no_classpath": ~filled("classpath"),
        "maker_code": F.coalesce(F.col("part_manuf").rlike(r"\([A-Za-z0-9-]+\)\s*$"), F.lit(False)), "fraction_size": F.coalesce(F.col("part_desc").rlike(r"[0-9]/[0-9]"), F.lit(False)),
    }
    labels = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))
    counted = df.select(F.explode(labels).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.unionByName(repeated.filter("n_rows > 0").select(F.lit("repeated_mpn").alias("category"), "n_rows"))
