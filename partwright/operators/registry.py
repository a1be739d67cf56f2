"""Reference joins: tiered lookup, codes, longest prefixes, unambiguous parents, controlled values."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partwright.functions import text
from partwright.session import broadcast_if_small


def registry_keys(registry: DataFrame) -> DataFrame:
    """The keys by which entries are found: ``kind``, ``record_id``, ``tier`` (1 exact, 2 lower case, 3 canonical), ``key``."""
    names = registry.select(F.col("record_kind").alias("kind"), "record_id", F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    n = F.col("name")
    tiers = F.array(*[F.struct(F.lit(t).alias("tier"), k.alias("key")) for t, k in ((1, n), (2, F.lower(text.collapse(n))), (3, text.canonical_key(n)))])
    return names.select("kind", "record_id", F.inline(tiers)).filter("key != ''").distinct()


def resolve(values: DataFrame, registry: DataFrame, kind: str, value: str = "value") -> DataFrame:
    """The first tier at which a distinct value meets entries: ``value``, ``status``, ``tier``, ``record_id``, ``n_candidates``.

    One entry is RESOLVED, more are AMBIGUOUS (no id), none UNRESOLVED; nulls and blanks are dropped,
    repeated values come out once.  The key table is broadcast when counted within the bound.
    """
    keys = registry_keys(registry.filter(F.col("record_kind") == kind)).drop("kind")
    v = F.col(value)
    asked = values.select(value).filter(F.trim(v) != "").distinct()
    tiers = F.array(*[F.struct(F.lit(t).alias("tier"), k.alias("key")) for t, k in ((1, v), (2, F.lower(text.collapse(v))), (3, text.canonical_key(v)))])
    long = asked.select(value, F.inline(tiers))
    hits = long.join(broadcast_if_small(keys, keys.count()), ["tier", "key"])
    by_tier = hits.groupBy(value, "tier").agg(F.countDistinct("record_id").alias("n"), F.min("record_id").alias("id"))
    best = by_tier.groupBy(value).agg(F.min(F.struct("tier", "n", "id")).alias("b"))
    return asked.join(best, value, "left").select(
        value,
        F.when(F.col("b").isNull(), "UNRESOLVED").when(F.col("b.n") == 1, "RESOLVED").otherwise("AMBIGUOUS").alias("status"),
        F.col("b.tier").alias("tier"), F.when(F.col("b.n") == 1, F.col("b.id")).alias("record_id"), F.coalesce("b.n", F.lit(0)).cast("bigint").alias("n_candidates"),
    )


def fuzzy(values: DataFrame, registry: DataFrame, kind: str, at_least: float = 0.88, top: int = 5) -> DataFrame:
    """Entries whose canonical key is like an unresolved value's by matching-block ratio: ``value``, ``record_id``, ``ratio``, ``place``.

    Blocked by key length, since a ratio r needs lengths within r/(2-r) of each other; the registry side
    is spread over the lengths it can meet, so the join is an equality.
    """
    names = registry.filter(F.col("record_kind") == kind).select("record_id", text.canonical_key(F.col("canonical_name")).alias("rk")).filter("rk != ''")
    low = at_least / (2 - at_least)
    n = F.length("rk")
    spread = names.select("record_id", "rk", F.explode(F.sequence(F.ceil(n * low).cast("int"), F.floor(n / low).cast("int"))).alias("len"))
    asked = values.select("value", text.canonical_key(F.col("value")).alias("k")).filter("k != ''").distinct().withColumn("len", F.length("k"))

    def ratio(batches):
        for pdf in batches:
            r = [difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(pdf["k"], pdf["rk"])]
            pdf = pdf.assign(ratio=r)
            yield pdf[pdf["ratio"] >= at_least][["value", "record_id", "ratio"]]

    pairs = asked.join(broadcast_if_small(spread, spread.count()), "len").select("value", "k", "record_id", "rk").mapInPandas(ratio, "value string, record_id string, ratio double")
    place = Window.partitionBy("value").orderBy(F.desc("ratio"), "record_id")
    return pairs.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= top)


def only_parent(registry: DataFrame) -> DataFrame:
    """Brand keys that lead to exactly one maker: ``brand_key``, ``manufacturer_id``."""
    brands = registry.filter("record_kind = 'BRAND' and manufacturer_id is not null").select(text.canonical_key(F.col("canonical_name")).alias("brand_key"), "manufacturer_id")
    return brands.groupBy("brand_key").agg(F.countDistinct("manufacturer_id").alias("n"), F.min("manufacturer_id").alias("manufacturer_id")).filter("n = 1").drop("n")


def longest_prefix(df: DataFrame, column: str, prefixes: DataFrame) -> DataFrame:
    """Each row with the ``label`` of the longest prefix (``prefix``, ``label``) that its value begins with; null without one.

    The prefix lengths, a handful, are read first; each length is an equality join on the cut value.
    """
    lengths = [r[0] for r in prefixes.select(F.length("prefix").alias("n")).distinct().orderBy(F.desc("n")).collect()]
    small = broadcast_if_small(prefixes.select(F.upper("prefix").alias("_p"), F.col("label").alias("_l")), prefixes.count())
    cuts = F.array(*[F.struct(F.lit(n).alias("n"), F.substring(F.upper(F.col(column)), 1, n).alias("_p")) for n in lengths]) if lengths else F.array().cast("array<struct<n:int,_p:string>>")
    distinct = df.select(column).distinct()
    hits = distinct.select(column, F.inline(cuts)).filter(F.length("_p") == F.col("n")).join(small, "_p").groupBy(column).agg(F.max_by("_l", "n").alias("label"))
    return df.join(hits, column, "left")


def controlled_rules(rules: DataFrame) -> DataFrame:
    """Rules with cells left blank below a heading filled from above, by ``rule_id`` within one sheet, blank values split by line."""
    def fill(c: str):
        return F.last(F.nullif(F.trim(F.col(c)), F.lit("")), ignorenulls=True).over(Window.partitionBy("sheet").orderBy("rule_id").rowsBetween(Window.unboundedPreceding, 0))

    return rules.withColumns({c: fill(c) for c in ("classpath", "leaf_node", "attribute_label")})


def rule_for(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule of a (classpath, attribute): by path, else by leaf, else by attribute where only one rule has it.

    ``asked`` and ``rules`` have classpath, leaf, attribute (``rules`` also rule_id); the rule table is
    small and broadcast after a count.  Fails closed: null where no tier gives exactly one.
    """
    n = rules.count()
    def tier(keys: list[str], name: str) -> DataFrame:
        got = rules.groupBy(*keys).agg(F.min("rule_id").alias(name), F.count(F.lit(1)).alias("_n"))
        return broadcast_if_small((got.filter("_n = 1") if keys == ["attribute"] else got).drop("_n"), n)

    out = asked.join(tier(["classpath", "attribute"], "_a"), ["classpath", "attribute"], "left")
    out = out.join(tier(["leaf", "attribute"], "_b"), ["leaf", "attribute"], "left").join(tier(["attribute"], "_c"), ["attribute"], "left")
    tiers = F.when(F.col("_a").isNotNull(), "path").when(F.col("_b").isNotNull(), "leaf").when(F.col("_c").isNotNull(), "attribute")
    return out.withColumn("rule_id", F.coalesce("_a", "_b", "_c")).withColumn("tier", tiers).drop("_a", "_b", "_c")


def brand_of_maker(asked: DataFrame, registry: DataFrame) -> DataFrame:
    """Brand names looked for among one maker's brands: ``manufacturer_id``, ``key``, ``record_id``, ``reason``.

    ``asked`` has manufacturer_id and key (canonical).  A maker without brands gives
    'no_brands_for_manufacturer', a name that several of its brands share 'ambiguous'.
    """
    brands = registry.filter("record_kind = 'BRAND' and manufacturer_id is not null")
    names = brands.select("manufacturer_id", "record_id", F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    keys = names.select("manufacturer_id", "record_id", text.canonical_key(F.col("name")).alias("key")).filter("key != ''")
    keys = keys.groupBy("manufacturer_id", "key").agg(F.countDistinct("record_id").alias("n"), F.min("record_id").alias("id"))
    owners = brands.select("manufacturer_id", F.lit(True).alias("has")).distinct()
    n = keys.count()
    out = asked.join(broadcast_if_small(owners, n), "manufacturer_id", "left").join(broadcast_if_small(keys, n), ["manufacturer_id", "key"], "left")
    reason = F.when(F.col("has").isNull(), "no_brands_for_manufacturer").when(F.col("n").isNull(), "unresolved").when(F.col("n") > 1, "ambiguous").otherwise("resolved")
    return out.select("manufacturer_id", "key", F.when(F.col("n") == 1, F.col("id")).alias("record_id"), reason.alias("reason"))


def category_rules(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """The first rule of the best tier for each ``classpath``: ``tier`` 1 same path, 2 one path within the other, 3 same leaf, 4 leaf within the path; null for none.

    ``rules`` has path, leaf (both lower case) and rule_id, and is a fixed, small list; the equalities are
    joined first, and only paths that none of them tells are compared with the list by containment.
    """
    n = rules.count()
    q = asked.select("classpath", F.lower("classpath").alias("asked")).withColumn("own", F.trim(F.substring_index("asked", ">", -1)))
    first = lambda *by: broadcast_if_small(rules.groupBy(*by).agg(F.min("rule_id").alias("_".join(by) + "_id")), n)
    q = q.join(first("path").withColumnRenamed("path", "asked"), "asked", "left").join(first("leaf").withColumnRenamed("leaf", "own"), "own", "left")
    rest = q.filter("path_id is null").select("classpath", "asked")
    path, leaf = F.contains("asked", "path") | F.contains("path", "asked"), F.contains("asked", "leaf")
    held = rest.join(F.broadcast(rules), path | leaf).groupBy("classpath").agg(F.min(F.when(path, F.col("rule_id"))).alias("within_id"), F.min(F.when(leaf, F.col("rule_id"))).alias("in_id"))
    q = q.join(held, "classpath", "left")
    tiers = ["path_id", "within_id", "leaf_id", "in_id"]
    tier = F.when(F.lit(False), 0)
    for i, c in enumerate(tiers, 1):
        tier = tier.when(F.col(c).isNotNull(), i)
    return q.select("classpath", tier.alias("tier"), F.coalesce(*tiers).alias("rule_id"))
