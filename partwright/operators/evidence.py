"""Competing values, their conflicts, and the evidence behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partwright.functions import text
from partwright.session import broadcast_if_small

# How much a source's word weighs, best first.
AUTHORITY = ["AUTHORITATIVE", "HIGH", "MANUFACTURER_PAGE", "AUTHORIZED_DISTRIBUTOR", "SECONDARY", "UNKNOWN"]


def authority_rank(c: Column) -> Column:
    """0 for the best authority; unknown and missing ones rank last."""
    return F.coalesce(F.array_position(F.array(*[F.lit(a) for a in AUTHORITY]), F.upper(F.trim(c))) - 1, F.lit(-1)).cast("int")


def ranked_authority(c: Column) -> Column:
    r = authority_rank(c)
    return F.when(r < 0, len(AUTHORITY) - 1).otherwise(r)


def conflicts(candidates: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Per key the distinct values (apart from case and space) in first-seen order, where there are two or more.

    ``n_values`` and ``values`` joined by ' | '.  Values are first reduced to one row each, so a hot key
    does not gather its rows; nulls and blanks are no values.
    """
    v = F.lower(text.collapse(F.col(value)))
    first = candidates.filter(v != "").groupBy(*keys, v.alias("_v")).agg(F.min(F.struct(F.col(order), F.col(value))).alias("_f"))
    held = first.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values"), F.array_sort(F.collect_list("_f")).alias("_all")).filter("n_values > 1")
    return held.select(*keys, "n_values", F.array_join(F.transform("_all", lambda x: text.collapse(x[value])), " | ").alias("values"))


def settle(candidates: DataFrame, keys: list[str], value: str, rank: str, order: str) -> DataFrame:
    """One verdict per key: the best-ranked value if it stands alone at its rank, else ESCALATE among the two best ranks, else REVIEW.

    ``resolution``, ``chosen``, ``n_values``.  A key with one value is CLEAR.
    """
    v = F.lower(text.collapse(F.col(value)))
    per_value = candidates.filter(v != "").groupBy(*keys, v.alias("_v")).agg(F.min(rank).alias("_r"), F.min(F.struct(F.col(order), F.col(value))).alias("_f"))
    best = per_value.groupBy(*keys).agg(F.min("_r").alias("_top"), F.count(F.lit(1)).alias("n_values"))
    same = [F.col(f"v.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    at_top = per_value.alias("v").join(best.alias("b"), [*same, F.col("v._r") == F.col("b._top")]).select(*[F.col(f"v.{k}").alias(k) for k in keys], "_f", "_top", "n_values")
    held = at_top.groupBy(*keys).agg(F.first("_top").alias("_top"), F.first("n_values").alias("n_values"), F.count(F.lit(1)).alias("_n"), F.min("_f").alias("_f"))
    verdict = F.when(F.col("n_values") == 1, "CLEAR").when(F.col("_n") == 1, "AUTHORITATIVE").when(F.col("_top") <= 1, "ESCALATE").otherwise("REVIEW")
    return held.select(*keys, verdict.alias("resolution"), F.when(verdict.isin("CLEAR", "AUTHORITATIVE"), text.collapse(F.col("_f")[value])).alias("chosen"), "n_values")


def cited_unknown(proposals: DataFrame, cited: str, known: DataFrame, known_id: str, *keys: str) -> DataFrame:
    """Proposals that cite ids which no packet holds: keys and the number of unknown ids; proposals without ids do not count."""
    spread = proposals.select(*keys, F.explode(F.array_distinct(cited)).alias("_id"))
    return spread.join(known.select(F.col(known_id).alias("_id")).distinct(), "_id", "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_unknown"))


def top_chunks(chunks: DataFrame, key: str, chunk_text: str, order: str, terms: DataFrame, term: str, term_key: str, k: int = 8, presence: bool = False) -> DataFrame:
    """Per term set the chunks that hold its words most often: ``term_key``, key, ``score``, ``place`` up to ``k``.

    Ties go to the earlier chunk.  With ``presence`` the score is the number of terms that occur at all,
    and ties go to the later chunk.  Chunks are cut into words, which meet the terms by equality.
    """
    words = chunks.select(key, order, F.explode(F.split(F.lower(F.col(chunk_text)), r"[^\p{L}\p{N}]+")).alias(term))
    words = words.groupBy(key, order, term).agg(F.count(F.lit(1)).alias("_n"))
    met = words.join(broadcast_if_small(terms.select(term, term_key), terms.count()), term)
    total = met.groupBy(term_key, key, order).agg((F.count(F.lit(1)) if presence else F.sum("_n")).alias("score"))
    rank = Window.partitionBy(term_key).orderBy(F.desc("score"), F.desc(order) if presence else F.asc(order))
    return total.withColumn("place", F.row_number().over(rank)).filter(F.col("place") <= k).select(term_key, key, "score", "place")
