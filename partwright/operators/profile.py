"""Profiles, duplicates and header checks of tabular data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partwright.functions import identifiers, text
from partwright.session import join_values


def detected_type(c: Column) -> Column:
    """The type a cell's text reads as: bool, date, int, float or string; told by pattern, never by cast."""
    s = text.strip(c)
    return (
        F.when(c.isNull() | (s == ""), F.lit(None).cast("string")).when(F.lower(s).isin("true", "false"), "bool").when(s.rlike(r"^\d{4}-\d{2}-\d{2}([ T].*)?$"), "date")
        .when(s.rlike(r"^[+-]?\d+$"), "int").when(s.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$"), "float").otherwise("string")
    )


def cells(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """Long form: ``column_name``, ``value`` as text, beside the kept columns; null cells stay."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(*keep, F.inline(pairs))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: rows, nulls, blanks, placeholders, distinct texts and the detected types.

    Cells are first counted per distinct text, so that a hot value costs one row of the shuffle; an
    empty table gives no row.
    """
    per_value = cells(df, columns).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    v = F.col("value")
    return per_value.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(v.isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.sum(F.when(text.strip(v) == "", F.col("n")).otherwise(0)).alias("n_blank"),
        F.sum(F.when(text.strip(v).isin(text.PLACEHOLDERS), F.col("n")).otherwise(0)).alias("n_placeholder"),
        F.count(v).alias("n_distinct"),
        F.array_join(F.array_sort(F.collect_set(detected_type(v))), ",").alias("types"),
    )


def representatives(df: DataFrame, columns: list[str], order: str, n: int = 5) -> DataFrame:
    """The first ``n`` distinct texts of each column in the order they were first seen."""
    seen = cells(df, columns, order).filter("value is not null").groupBy("column_name", "value").agg(F.min(order).alias("first_seen"))
    # per value one row is left; the top n come from a partial top per task, then one small window
    rank = Window.partitionBy("column_name").orderBy("first_seen", "value")
    return seen.withColumn("place", F.row_number().over(rank)).filter(F.col("place") <= n).select("column_name", "place", "value")


def resent(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows whose content (by row hash over ``columns``) was seen under a smaller key: key, ``first_key``, ``row_hash``."""
    hashed = df.select(key, identifiers.row_hash(*[F.col(c) for c in columns]).alias("row_hash"))
    first = hashed.groupBy("row_hash").agg(F.min(key).alias("first_key"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return join_values(hashed, first, ["row_hash"], "n", df.count()).filter(F.col(key) > F.col("first_key")).select(key, "first_key", "row_hash")


def duplicate_groups(df: DataFrame, column: str) -> DataFrame:
    """Groups of rows that share a value apart from case and surrounding space: ``value``, ``n_rows``."""
    v = F.upper(text.strip(F.col(column)))
    return df.filter(v != "").groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def unique_headers(headers: list[str | None]) -> list[str]:
    """Header names made usable: trimmed, blanks as ``__unnamed_N`` by position from 1, the k-th repeat as ``name#k``."""
    seen: dict[str, int] = {}
    out = []
    for position, header in enumerate(headers, 1):
        name = (header or "").strip() or f"__unnamed_{position}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}#{seen[name]}")
    return out


def header_check(expected: list[str], found: list[str]) -> dict:
    """How a file's header differs from a contract: missing, unexpected and repeated names, and whether the order changed."""
    missing, unexpected = [h for h in expected if h not in found], [h for h in found if h not in expected]
    repeated = sorted({h for h in found if found.count(h) > 1})
    common_e, common_f = [h for h in expected if h in found], [h for h in dict.fromkeys(found) if h in expected]
    return {"valid": not missing and not unexpected and not repeated and common_e == common_f, "missing": missing, "unexpected": unexpected, "duplicate": repeated, "order_changed": common_e != common_f}
