"""Reference tables out of sheets, and objects embedded in scripts."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partwright.functions import text


def unit_master(rows: DataFrame, approved: str, synonyms: str) -> DataFrame:
    """One row per way a unit is written: ``written`` in lower case and the approved ``unit``; the approved form itself included.

    Synonyms are split at commas, semicolons, slashes, bars and line breaks; blanks fall away; where two
    units claim one form the smaller unit keeps it.
    """
    u = text.strip(F.col(approved))
    forms = F.concat(F.array(u), F.split(F.coalesce(F.col(synonyms), F.lit("")), r"[,;/|\r\n]+"))
    long = rows.filter(u != "").select(u.alias("unit"), F.explode(forms).alias("w")).select("unit", F.lower(text.strip(F.col("w"))).alias("written"))
    return long.filter("written != ''").groupBy("written").agg(F.min("unit").alias("unit"))


def fraction_pairs(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """Fractions and decimals that stand side by side in either order: ``fraction``, ``decimal``, each pair once."""
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.size(cells) - 1, F.lit(1))), lambda i: F.struct(F.trim(F.try_element_at(F.col(cells), i)).alias("a"), F.trim(F.try_element_at(F.col(cells), i + 1)).alias("b")))
    pairs = rows.filter(F.size(cells) > 1).select(F.inline(at))
    frac, dec = r"^(\d+[- ])?\d+/\d+$", r"^\d*\.?\d+$"
    kept = pairs.select(
        F.when(F.col("a").rlike(frac) & F.col("b").rlike(dec), F.col("a")).when(F.col("b").rlike(frac) & F.col("a").rlike(dec), F.col("b")).alias("fraction"),
        F.when(F.col("a").rlike(frac) & F.col("b").rlike(dec), F.col("b")).when(F.col("b").rlike(frac) & F.col("a").rlike(dec), F.col("a")).cast("double").alias("decimal"),
    )
    return kept.filter("fraction is not null").select(F.replace("fraction", F.lit(" "), F.lit("-")).alias("fraction"), "decimal").distinct()


def find_files(spark: SparkSession, roots: list[str], pattern: str) -> DataFrame:
    """Files below the roots that fit a glob: ``name``, ``path``, ``length``; of one name the first root's; hidden folders skipped."""
    found = None
    for i, root in enumerate(roots):
        part = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length", F.lit(i).alias("_root"))
        found = part if found is None else found.unionByName(part)
    named = found.filter(~F.col("path").rlike(r"/\.[^/]+/")).withColumn("name", F.substring_index("path", "/", -1))
    first = Window.partitionBy("name").orderBy("_root", "path")
    return named.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("name", "path", "length")


def embedded_objects(body: str, marker: str) -> list[str]:
    """The JSON objects that follow a marker, cut where their braces balance; braces inside strings do not count."""
    out, at = [], 0
    while (at := body.find(marker, at)) >= 0:
        at += len(marker)
        start = body.find("{", at)
        if start < 0:
            break
        depth, quoted, escaped = 0, False, False
        for i in range(start, len(body)):
            c = body[i]
            if quoted:
                quoted, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
            elif c == '"':
                quoted = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if depth == 0:
                    try:
                        json.loads(body[start : i + 1])
                        out.append(body[start : i + 1])
                    except ValueError:
                        pass
                    at = i + 1
                    break
        else:
            break
    return out


def script_objects(df: DataFrame, key: str, body: str, marker: str) -> DataFrame:
    """One row per embedded object: key, ``place``, ``payload`` (whole JSON texts only); nulls and texts without the marker give none."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = [(k, n, o) for k, b in zip(pdf["_key"], pdf["_body"]) for n, o in enumerate(embedded_objects(b, marker), 1)]
            yield pd.DataFrame(rows, columns=["_key", "place", "payload"])

    rows = df.filter(F.contains(F.col(body), F.lit(marker))).select(F.col(key).alias("_key"), F.col(body).alias("_body"))
    return rows.mapInPandas(run, f"_key {kind}, place int, payload string").withColumnRenamed("_key", key)
