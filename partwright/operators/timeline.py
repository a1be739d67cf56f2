"""Rolling limits, failure streaks, expiry and idempotent loading over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_load(events: DataFrame, by: list[str], ts: str, seconds: int = 60) -> DataFrame:
    """Each event with the events of its key in the ``seconds`` before it, the event itself included, the far edge not.

    Time is cut into stretches of that length and every event also shown to the next stretch, so that a
    key with very many events is spread over its stretches.  Events without a time get null.
    """
    span = seconds * 1_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    shown = events.withColumn("_us", micros).withColumn("_own", F.floor(F.col("_us") / span))
    shown = shown.withColumn("_at", F.explode(F.array("_own", F.col("_own") + 1)))
    w = Window.partitionBy(*by, "_at").orderBy("_us").rangeBetween(-(span - 1), 0)
    counted = shown.withColumn("in_window", F.when(F.col("_us").isNotNull(), F.count(F.lit(1)).over(w)))
    timed = counted.filter("_own = _at").drop("_us", "_own", "_at")
    untimed = events.filter(F.col(ts).isNull()).withColumn("in_window", F.lit(None).cast("bigint"))
    return timed.unionByName(untimed)


def running_sum(events: DataFrame, by: str, ts: str, tie: str, value: Column, days: int = 1) -> DataFrame:
    """Each event with ``running``, the sum of ``value`` over its key up to it in the order of time and ``tie``.

    Time is cut into stretches of ``days``: the sums before a stretch come from one row for each stretch, so
    that a key with very many events is spread over its stretches.  Null values count as nothing.
    """
    cut_at = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (days * 86_400_000_000))
    rows = events.withColumn("_d", F.coalesce(cut_at, F.lit(-(1 << 40)))).withColumn("_v", value)
    inner = F.sum("_v").over(Window.partitionBy(by, "_d").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0))
    sums = rows.groupBy(F.col(by).alias("_by"), F.col("_d").alias("_day")).agg(F.sum("_v").alias("_s"))
    before = sums.withColumn("_before", F.sum("_s").over(Window.partitionBy("_by").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)))
    joined = rows.withColumn("_in", inner).join(before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_d") == F.col("_day")))
    total = F.when(F.col("_in").isNotNull() | F.col("_before").isNotNull(), F.coalesce("_in", F.lit(0)) + F.coalesce("_before", F.lit(0)))
    return joined.withColumn("running", total).drop("_d", "_v", "_in", "_by", "_day", "_s", "_before")


def sessions(events: DataFrame, by: str, ts: str, gap_seconds: int, days: int = 7) -> DataFrame:
    """Each event with ``session``, numbered from 0 in its key: a new one begins after more than ``gap_seconds`` without events.

    Gaps are counted within stretches of ``days``, and between them from one row for each stretch, so that a
    key with very many events is spread over its stretches.  Events without a time are left out.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.filter(F.col(ts).isNotNull()).withColumn("_us", us).withColumn("_d", F.floor(us / (days * 86_400_000_000)))
    w = Window.partitionBy(by, "_d").orderBy("_us")
    rows = rows.withColumn("_gap", (F.coalesce(F.col("_us") - F.lag("_us").over(w), F.lit(0)) > gap_seconds * 1_000_000).cast("bigint")).withColumn("_in", F.sum("_gap").over(w))
    per = rows.groupBy(F.col(by).alias("_by"), F.col("_d").alias("_day")).agg(F.min("_us").alias("_lo"), F.max("_us").alias("_hi"), F.sum("_gap").alias("_n"))
    order = Window.partitionBy("_by").orderBy("_day")
    fresh = (F.coalesce(F.col("_lo") - F.lag("_hi").over(order), F.lit(0)) > gap_seconds * 1_000_000).cast("bigint")
    per = per.withColumn("_new", fresh + F.coalesce(F.lag("_n").over(order), F.lit(0))).withColumn("_before", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = rows.join(per.select("_by", "_day", "_before"), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_d") == F.col("_day")))
    return joined.withColumn("session", F.col("_in") + F.col("_before")).drop("_us", "_d", "_gap", "_in", "_by", "_day", "_before")


def admitted(events: DataFrame, key: str, ts: str, weight: str, max_events: int, max_weight: float, seconds: int = 60) -> DataFrame:
    """Sequential admission: an event passes while the admitted ones of the last ``seconds`` leave room for it.

    Each admission depends on the ones before, so a key's events are taken in order by one task; give a
    key that splits hot groups.  ``admitted`` and ``reason`` (events, weight or null).
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from collections import deque

        pdf = pdf.sort_values(["_us", "_seq"], kind="stable")
        window: deque = deque()
        used = 0.0
        ok, why = [], []
        for us, w in zip(pdf["_us"], pdf["_w"]):
            while window and us - window[0][0] >= seconds * 1_000_000:
                used -= window.popleft()[1]
            reason = "events" if len(window) >= max_events else "weight" if used + w > max_weight else None
            if reason is None:
                window.append((us, w))
                used += w
            ok.append(reason is None)
            why.append(reason)
        return pd.DataFrame({"_seq": pdf["_seq"], "_key": pdf["_key"], "admitted": ok, "reason": pd.Series(why, dtype="object", index=pdf.index)})

    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col("event_id").alias("_seq"), F.col(key).alias("_key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("_w"))
    return rows.groupBy("_key").applyInPandas(run, f"_seq bigint, _key {kind}, admitted boolean, reason string").withColumnsRenamed({"_seq": "event_id", "_key": key})


def failure_streaks(events: DataFrame, by: str, ts: str, failed, limit: int, days: int = 1) -> DataFrame:
    """Each event with the failures of its key since the last success, and OPEN or CLOSED by the limit.

    Time is cut into stretches of ``days``; a stretch is summed up by its successes and the failures after
    the last one, and only these sums are carried along a key, so no task holds all events of a hot key.
    """
    rows = events.withColumn("_f", F.coalesce(failed, F.lit(False)).cast("int")).withColumn("_b", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (days * 86_400_000_000)))
    here = Window.partitionBy(by, "_b").orderBy(ts)
    rows = rows.withColumn("_s", F.sum(1 - F.col("_f")).over(here))
    within = Window.partitionBy(by, "_b", "_s").orderBy(ts)
    rows = rows.withColumn("_run", F.sum("_f").over(within))
    sums = rows.groupBy(by, "_b").agg(F.sum(1 - F.col("_f")).alias("wins"), F.max(F.struct("_s", "_run"))["_run"].alias("tail"))
    along = Window.partitionBy(by).orderBy("_b")
    sums = sums.withColumn("_i", F.sum(F.when(F.col("wins") > 0, 1).otherwise(0)).over(along))
    carried = F.sum("tail").over(Window.partitionBy(by, "_i").orderBy("_b"))
    sums = sums.withColumn("_upto", carried).withColumn("_carry", F.coalesce(F.lag("_upto").over(along), F.lit(0)))
    out = rows.join(sums.select(F.col(by).alias("_k"), F.col("_b").alias("_kb"), "_carry"), (F.col(by).eqNullSafe(F.col("_k"))) & (F.col("_b") == F.col("_kb")))
    streak = F.col("_run") + F.when(F.col("_s") == 0, F.col("_carry")).otherwise(0)
    return out.withColumn("streak", streak).withColumn("state", F.when(F.col("streak") >= limit, "OPEN").otherwise("CLOSED")).select(*events.columns, "streak", "state")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last version of each key: one row with the greatest order columns; partial maxima before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])).alias("_b"))
    return best.select(*keys, *[F.col("_b")[c].alias(c) for c in rest])


def fresh(df: DataFrame, keys: list[str], ts: str, at, seconds: int) -> DataFrame:
    """The cache view at a point in time: per key the last entry before it and HIT or STALE by its age."""
    last = df.filter(F.col(ts) <= at).groupBy(*keys).agg(F.max(ts).alias("last_ts"))
    age = F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp"))
    return last.withColumn("state", F.when(age < seconds * 1_000_000, "HIT").otherwise("STALE"))


def load_once(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows that no earlier load holds, one per key, so that loading twice changes nothing."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")
