"""Quantities recorded in different units.

Two operators.  ``measured_values`` reads the numbers and units out of text attributes, takes
candidate units from the text itself or from the record's note, and keeps every reading of a number.
What is open is settled by identities, the reading with the smallest log residual holds: between the two
statements of one quantity in a text, between the records of one product, and between a value and the
typical size of the quantity in its source.  Where two readings come as close, the value is flagged.
``resolve_source_units`` does the same for numeric columns of whole sources, where columns are tied
by products such as mass = density x volume.
"""

from __future__ import annotations

import itertools
import math
import re
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwright.session import broadcast_if_small, cut, join_values, spread

# The size of each unit in the common unit of its quantity.
LENGTH = {
    "mm": 1_000_000, "cm": 10_000_000, "m": 1_000_000_000, "um": 1_000, "in": 25_400_000, "ft": 304_800_000, "mil": 25_400,
}  # nanometres
ROTATION = {"rpm": 1, "rps": 60, "krpm": 1000}  # revolutions per minute
FEED = {
    "m/min": 1_000_000, "mm/min": 1_000, "cm/min": 10_000, "mm/s": 60_000, "cm/s": 600_000, "m/s": 60_000_000,
    "ft/min": 304_800, "ft/s": 18_288_000, "in/min": 25_400, "in/s": 1_524_000,
}  # micrometres per minute

# Ways in which the units are written, as regular expressions in lower case.
_MIN, _SEC = r"(?:minutes?|min)\b\.?", r"(?:seconds?|sec|s)\b\.?"
_FEET, _INCH = r"(?:feet|foot|ft\.?|['’′])", r"(?:inch(?:es)?|in\.?)"
_MM, _CM, _M = r"(?:millimet(?:er|re)s?|mm)", r"(?:centimet(?:er|re)s?|cm)", r"(?:met(?:er|re)s?|m)"


def _per(length: str, time: str) -> str:
    return rf"{length}\s*(?:/|per)\s*{time}"


FEED_WRITTEN = [
    (_per(_MM, _MIN), "mm/min"), (_per(_CM, _MIN), "cm/min"), (_per(_MM, _SEC), "mm/s"), (_per(_CM, _SEC), "cm/s"),
    (_per(_M, _MIN) + r"|mpm\b", "m/min"), (_per(_M, _SEC), "m/s"), (_per(_FEET, _MIN) + r"|fpm\b|sfpm\b", "ft/min"),
    (_per(_FEET, _SEC) + r"|fps\b", "ft/s"), (_per(_INCH, _MIN) + r"|ipm\b", "in/min"), (_per(_INCH, _SEC) + r"|ips\b", "in/s"),
]
ROTATION_WRITTEN = [
    (r"krpm\b", "krpm"),
    (r"(?:revolutions?|revs?|rotations?|r|u)\s*(?:/|per)\s*" + _SEC + r"|rps\b|r\.p\.s\.?", "rps"),
    (r"rpm\b|r\.\s?p\.\s?m\.?|(?:revolutions?|revs?|rotations?|r|u|1|)\s*(?:/|per)\s*" + _MIN + r"|min\s*(?:⁻¹|\^?-1\b|-¹)", "rpm"),
]
LENGTH_WRITTEN = [
    (r"(?:millimet(?:er|re)s?|mm)\b\.?", "mm"), (r"(?:centimet(?:er|re)s?|cm)\b\.?", "cm"),
    (r"(?:micromet(?:er|re)s?|microns?|[uµμ]m)\b\.?", "um"), (r"(?:mils?|thous?)\b\.?", "mil"),
    (r"(?:inch(?:es)?|in)\b\.?|\"|″|”|''", "in"), (r"(?:feet|foot|ft)\b\.?|['’′]", "ft"), (r"(?:met(?:er|re)s?|m)\b\.?", "m"),
]
# Quantities of another kind, which are not converted.
OTHER_KIND = r"\b(?:cuts?\s*(?:per|/)\s*inch|cpi|spm|bpm|strokes?|blows?|ga|gauge|awg|rim|tpi|hz|db|lbs?|kg|volts?|v|amps?|watts?|w|hp|°|deg(?:rees)?)\b|\bgauge\b"
_WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
_WORD_NUMBER = {w: Fraction(i + 1) for i, w in enumerate(_WORDS)}
_PART = {"half": 2, "halves": 2, "third": 3, "thirds": 3, "quarter": 4, "quarters": 4, "fourth": 4, "fourths": 4, "eighth": 8, "eighths": 8, "sixteenth": 16, "sixteenths": 16}
_VULGAR = {"½": "1/2", "¼": "1/4", "¾": "3/4", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8", "⅓": "1/3", "⅔": "2/3", "⅙": "1/6", "⅚": "5/6", "⅕": "1/5", "⅖": "2/5", "⅗": "3/5", "⅘": "4/5"}

_VULGAR_SIGN = re.compile("(?<=\\d)\\s*([{0}])|([{0}])".format("".join(_VULGAR)))
_OTHER_KIND = re.compile(OTHER_KIND)
_TOLERANCE = re.compile(r"(?:±|\+\s*/\s*-|\+-)\s*\d[\d.,]*(?=(\s*[a-zµ\"″']*))")
_ORDINAL = re.compile(r"\b\d+\s*(?:st|nd|rd|th)\b(?:\s+gear)?|\bn[0o₀]?\s*=|\b[a-z]+[- ]speed:")

QUANTITIES = {"Feed Speed": ("feed", FEED, FEED_WRITTEN), "No Load Speed": ("rotation", ROTATION, ROTATION_WRITTEN), "Diameter": ("length", LENGTH, LENGTH_WRITTEN), "Thickness": ("length", LENGTH, LENGTH_WRITTEN)}
# A restated value may differ by the rounding of both readings and by this share more.
RESTATE_TOLERANCE = 0.01
# A reading holds when its log residual lies this much below the next one's; sources with fewer settled values than MIN_SETTLED are measured by all sources.
MARGIN, MIN_SETTLED = math.log(3), 20

_WORD_RX = "|".join(_WORDS)
_PART_RX = "|".join(sorted(_PART, key=len, reverse=True))
_NUMBER = re.compile(
    rf"(?P<mixed>\d+(?:\s*-\s*|\s+)\d+/\d+)|(?P<frac>\d+/\d+)|(?P<dec>(?:\d{{1,3}}(?:[   ']\d{{3}})+(?![\d])(?:[.,]\d+)?|\d[\d.,]*\d|\d|(?<!\d)[.,]\d+))"
    rf"|(?P<wordpart>\b(?:(?P<wn>{_WORD_RX}|an?|half)[\s-]+)?(?:(?P<wp>{_PART_RX})\b)(?:\s+of)?(?:\s+an?\b)?|\bhalf\s+an?\b)|(?P<word>\b(?:{_WORD_RX})\b)"
)


def number_readings(text: str) -> list[Fraction]:
    """The readings of a decimal as written: signs that may part thousands or decimals give one reading each way."""
    s = re.sub(r"[   ']", "", text)
    out: list[Fraction] = []

    def add(x: str) -> None:
        try:
            v = Fraction(x if not x.startswith(".") else "0" + x)
        except (ValueError, ZeroDivisionError):
            return
        if v not in out:
            out.append(v)

    commas, dots = s.count(","), s.count(".")
    if commas and dots:
        last = max(s.rfind(","), s.rfind("."))
        whole, part = re.sub("[.,]", "", s[:last]), s[last + 1 :]
        add(f"{whole}.{part}")
    elif commas + dots == 1:
        sign = "," if commas else "."
        whole, part = s.split(sign)
        grouped = len(part) == 3 and 1 <= len(whole) <= 3 and not whole.startswith("0")
        if sign == "," and grouped:
            add(whole + part)
        add(f"{whole or 0}.{part}")
        if sign == "." and grouped:
            add(whole + part)
    elif commas + dots > 1:
        add(re.sub("[.,]", "", s))
    else:
        add(s)
    return out


def _slack(m: re.Match, values: list[Fraction]) -> float:
    """The share by which a decimal may be off through rounding to its last digit."""
    part = re.search(r"[.,](\d+)$", m["dec"] or "")
    if not m["dec"] or not values[0]:
        return 0.0
    digits = len(part.group(1)) if part and values[0].denominator != 1 else 0
    return float(Fraction(1, 2 * 10**digits) / values[0])


def _value_of(m: re.Match) -> list[Fraction]:
    if m["mixed"]:
        whole, num, den = re.match(r"(\d+)\D+(\d+)/(\d+)", m["mixed"]).groups()
        return [int(whole) + Fraction(int(num), int(den))] if int(den) else []
    if m["frac"]:
        num, den = m["frac"].split("/")
        return [Fraction(int(num), int(den))] if int(den) else []
    if m["dec"]:
        return number_readings(m["dec"])
    if m["wordpart"]:
        if not m["wp"]:
            return [Fraction(1, 2)]
        n = m["wn"]
        return [(_WORD_NUMBER.get(n, Fraction(1)) if n and n != "half" else Fraction(1)) * Fraction(1, _PART[m["wp"]])]
    return [_WORD_NUMBER[m["word"]]]


@lru_cache(maxsize=None)
def _unit_rx(kind: str) -> re.Pattern:
    written = {"feed": FEED_WRITTEN, "rotation": ROTATION_WRITTEN, "length": LENGTH_WRITTEN}[kind]
    return re.compile("|".join(f"(?P<u{i}>{rx})" for i, (rx, _) in enumerate(written)))


def _unit_at(kind: str, text: str, at: int) -> tuple[str, int] | None:
    written = {"feed": FEED_WRITTEN, "rotation": ROTATION_WRITTEN, "length": LENGTH_WRITTEN}[kind]
    m = _unit_rx(kind).match(text, at)
    return (written[int(m.lastgroup[1:])][1], m.end()) if m and m.end() > at else None


def note_units(note: str | None) -> dict[str, str]:
    """The unit that a note states for lengths, rotation and feed; a kind for which it states two different ones is left out."""
    found: dict[str, set[str]] = {}
    for part in re.split(r"\s*;\s*|\s+/\s+|(?<=[a-z²])\.{1,2}\s+(?=[A-Z])|\.\s+", note or ""):
        low = part.lower().strip().rstrip(".")
        feed = re.search(r"\b(?:in)?feed\b|vorschub|\badvance\b", low)
        spin = re.search(r"no-?\s?load|rotation|\bspeeds?\b|drehzahl|\brevs?\b|revolution|spindle", low)
        size = re.search(r"\bdimensions?\b|\blengths?\b|\bsizes?\b|diameter|thickness|\bmaße\b|\bmasse\b|measurements?", low)
        kind = "feed" if feed else "rotation" if spin else "length" if size else None
        if kind is None:
            continue
        tail = re.split(r"\b(?:are|in|as|is|unit)\b|:", low, maxsplit=1)
        for at in range(len(tail[0]) if len(tail) > 1 else 0, len(low)):
            if at and low[at - 1].isalpha():
                continue
            got = _unit_at(kind, low, at)
            if got and not (got[0] == "in" and re.match(r"in\s+\S", low[at:])):
                found.setdefault(kind, set()).add(got[0])
                break
    return {k: next(iter(v)) for k, v in found.items() if len(v) == 1}


def _clean(text: str) -> str:
    low = text.lower()
    if low.isascii():
        return low
    low = _VULGAR_SIGN.sub(lambda m: (f" {_VULGAR[m[1]]}" if m[1] else _VULGAR[m[2]]), low)
    return low.replace("−", "-").replace("⁄", "/").replace("‐", "-").replace("‑", "-")


def read_value(attribute: str, text: str | None, unit_hint: str | None) -> list[tuple[int, list[int]]]:
    """The measured values of one attribute text: (number, its readings in the common unit).

    ``unit_hint`` is the unit that the record states elsewhere.  Where a second statement of the same
    quantity stands beside it, only the readings that agree with it within rounding are left.
    """
    if not text or not text.strip() or attribute not in QUANTITIES:
        return []
    kind, factors, _ = QUANTITIES[attribute]
    low = _clean(text)
    if _OTHER_KIND.search(low):
        return []
    low = _ORDINAL.sub(" ", _TOLERANCE.sub(" ", low))
    items: list[dict] = []
    at = 0
    while m := _NUMBER.search(low, at):
        end = m.end()
        scale = Fraction(1)
        if kind == "rotation":
            k = re.match(r"\s*(?:[x×*]\s*1[.,\s]?000(?!\d)|k(?![a-z])|k(?=\s*rpm))", low[end:])
            if k and not re.match(r"\s*krpm", low[end:]):
                scale, end = Fraction(1000), end + k.end()
        skip = re.match(r"[\s-]*(?:\([a-z ]*\))?\s*", low[end:]) if m["word"] or m["wordpart"] else re.match(r"\s*(?:\((?!\s*\d)[a-z ]*\)\s*)?", low[end:])
        got = _unit_at(kind, low, end + skip.end())
        if not got and kind == "length":
            got = None
        unit, stop = got if got else (None, end)
        if m["dec"] and m["dec"][0] in ".," and m.start() and low[m.start() - 1].isdigit():
            at = end
            continue
        if values := _value_of(m):
            items.append({"start": m.start(), "end": stop, "values": [v * scale for v in values], "unit": unit, "slack": _slack(m, values)})
        at = stop
    # feet and inches written one after the other are one value
    merged: list[dict] = []
    for x in items:
        p = merged[-1] if merged else None
        if p and kind == "length" and p["unit"] == "ft" and x["unit"] == "in" and re.fullmatch(r"[\s,-]*", low[p["end"] : x["start"]]):
            p |= {"values": [p["values"][0] * 12 + x["values"][0]], "unit": "in", "end": x["end"]}
        else:
            merged.append(dict(x))
    items = merged
    # a unit holds for the numbers before it that have none of their own
    unit = None
    for x in reversed(items):
        unit = x["unit"] or unit
        x["use"] = x["unit"] or unit
    for x in items:
        x["use"] = x["use"] or unit_hint
    items = [x for x in items if x["use"]]
    out: list[list[Fraction]] = []
    k = 0
    while k < len(items):
        x = items[k]
        nxt = items[k + 1] if k + 1 < len(items) else None
        between = low[x["end"] : nxt["start"]] if nxt else ""
        if nxt and x["unit"] and nxt["unit"] and x["unit"] != nxt["unit"] and re.fullmatch(r"\s*[/(\[=,;]?\s*", between):
            # two units for what may be one quantity: the identity a = b settles readings and units
            options = sorted(
                (abs(math.log(float(a * factors[x["use"]]) / float(b * factors[nxt["use"]]))), i, a)
                for i, a in enumerate(x["values"]) for b in nxt["values"] if a > 0 and b > 0
            )
            limit = math.log1p(x["slack"] + nxt["slack"]) + RESTATE_TOLERANCE
            if options and options[0][0] <= limit:
                out.append([a * factors[x["use"]] for off, _, a in options if off <= limit])
                k += 2
                continue
        out.append([v * factors[x["use"]] for v in x["values"]])
        k += 1
    return [(n, list(dict.fromkeys(int(v + Fraction(1, 2)) for v in vs))) for n, vs in enumerate(out, 1)]


def _read_batches(batches):
    units = lru_cache(maxsize=100_000)(note_units)
    for pdf in batches:
        hints = [units(note).get(QUANTITIES[name][0]) if note else None for name, note in zip(pdf["_name"], pdf["_note"])]
        found = [read_value(name, text, hint) for name, text, hint in zip(pdf["_name"], pdf["_text"], hints)]
        yield pdf.assign(_values=[[{"value_no": n, "readings": r} for n, r in values] for values in found])


def _log(c: Column) -> Column:
    return F.ln(F.greatest(c, F.lit(1)).cast("double"))


def settled_readings(read: DataFrame, key: str, source: str, product: str) -> DataFrame:
    """The rows with ``common_value`` and ``unique_solution``: the reading with the least log residual.

    Read once for each distinct set of readings of a product: the residual is 0 where another record
    of the product has just one of them as its only reading, else the distance in logs from the mean of
    the settled values of the attribute in the source.  Where the next reading is not worse by MARGIN,
    or nothing is settled to compare with, the solution is not unique.
    """
    same, group = ["attribute_name", "value_no"], ["attribute_name", "value_no", "readings", "_of", "_from"]
    named = read.select(key, *same, "readings", F.coalesce(F.col(product), F.lit("")).alias("_of"), F.coalesce(F.col(source), F.lit("")).alias("_from"))
    sure = named.filter(F.size("readings") == 1).withColumn("v", F.col("readings")[0])
    still = named.filter(F.size("readings") > 1)
    sizes = cut(sure.filter("v > 0").groupBy("attribute_name", "_from").agg(F.sum(_log(F.col("v"))).alias("_l"), F.count(F.lit(1)).alias("_n")))
    every = sizes.groupBy("attribute_name").agg((F.sum("_l") / F.sum("_n")).alias("_all"))
    own = sizes.filter(F.col("_n") >= MIN_SETTLED).select("attribute_name", "_from", (F.col("_l") / F.col("_n")).alias("_own"))
    asked = cut(still.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows")))
    wanted = asked.filter("_of != ''").select("_of", *same).distinct()
    known = sure.join(broadcast_if_small(wanted, wanted.count()), ["_of", *same], "left_semi").groupBy("_of", *same).agg(F.collect_set("v").alias("_known"))
    asked = asked.join(known, ["_of", *same], "left").join(F.broadcast(every), "attribute_name", "left").join(broadcast_if_small(own, own.count()), ["attribute_name", "_from"], "left")
    told = F.coalesce("_known", F.array().cast("array<bigint>"))
    repeats = F.size(F.array_intersect("readings", told)) == 1
    apart = lambda v: F.coalesce(F.abs(_log(v) - F.coalesce("_own", "_all")), F.lit(0.0))
    residual = lambda v: F.when(repeats & F.array_contains(told, v), F.lit(0.0)).otherwise(apart(v) + F.when(repeats, F.lit(MARGIN)).otherwise(F.lit(0.0)))
    scored = asked.withColumn("_r", F.array_sort(F.transform("readings", lambda v, i: F.struct(residual(v).alias("off"), i.alias("at"), v.alias("v")))))
    chosen = cut(scored.select(*group, "_rows", F.col("_r")[0]["v"].alias("common_value"), (F.col("_r")[1]["off"] - F.col("_r")[0]["off"] >= MARGIN).alias("unique_solution")))
    total = chosen.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("t")).first()["t"]
    done = join_values(still, chosen, group, "_rows", total).select(key, *same, "common_value", "unique_solution")
    return sure.select(key, *same, F.col("v").alias("common_value"), F.lit(True).alias("unique_solution")).unionByName(done)


def measured_values(df: DataFrame, key: str, attributes: str, note: str, source: str, product: str) -> DataFrame:
    """One row per measured value: key, ``attribute_name``, ``value_no``, ``common_value``, ``unique_solution``.

    ``attributes`` is a map of texts, ``note`` a text that may state units, ``source`` and ``product`` say
    which records share their habits and which describe one thing.  Null maps, null and blank texts, words
    without a number, other kinds of quantity and numbers whose unit the record states nowhere give no
    row; repeated records give their rows under each key; an empty table gives an empty result.  Distinct
    texts (with their note) are read in Python once, one Arrow batch at a time; the readings go back to
    the records by a join that keeps common texts out of one task.
    """
    names = list(QUANTITIES)
    note_of = F.coalesce(F.col(note), F.lit(""))
    wide = df.select(F.col(key).cast("bigint").alias("_key"), note_of.alias("_note"), F.col(source).alias("_source"), F.col(product).alias("_product"), *[F.try_element_at(F.col(attributes), F.lit(n)).alias(n) for n in names])
    long = wide.select("_key", "_note", "_source", "_product", F.inline(F.array(*[F.struct(F.lit(n).alias("_name"), F.col(f"`{n}`").alias("_text")) for n in names])))
    long = long.filter((F.trim("_text") != "") & F.col("_text").rlike(r"[0-9½¼¾⅛⅜⅝⅞⅓⅔⅙⅚⅕⅖⅗⅘]|(?i)one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|teen|half|third|quarter|halves"))
    texts = cut(long.groupBy("_name", "_text", "_note").agg(F.count(F.lit(1)).alias("_rows")))
    got = cut(spread(texts, texts.count(), 4_000).mapInPandas(_read_batches, "_name string, _text string, _note string, _rows bigint, _values array<struct<value_no:int,readings:array<bigint>>>"))
    total = got.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("t")).first()["t"]
    read = join_values(long, got, ["_name", "_text", "_note"], "_rows", total).select("_key", "_source", "_product", F.col("_name").alias("attribute_name"), F.inline("_values"))
    return settled_readings(cut(read), "_key", "_source", "_product").withColumnRenamed("_key", key)


def resolve_source_units(df: DataFrame, source: str, columns: dict[str, dict[str, float]], identities: list[dict[str, float]], tolerance: float = 0.02) -> DataFrame:
    """The unit of each numeric column in each source: ``source``, ``column``, ``unit``, ``factor``, ``log_residual``, ``unique_solution``.

    ``columns`` gives the candidate units with their size in the common unit; an identity is a map
    column -> exponent whose product is 1 in common units, such as {"mass": 1, "density": -1,
    "volume": -1}.  Unit sizes add up in logs, so one aggregate per source (the mean log of each
    identity over rows where all its columns are positive) is enough, and the combinations are
    compared on that.  Where a second combination comes as close (within ``tolerance``) with another
    unit for the column, the solution is flagged as not unique.  Sources without usable rows get null
    units.  Nulls, zeros and negatives do not take part.
    """
    def log_sum(identity: dict[str, float]):
        return sum((F.lit(float(e)) * F.ln(F.when(F.col(c) > 0, F.col(c).cast("double"))) for c, e in identity.items()), F.lit(0.0))

    means = df.groupBy(F.col(source).alias("_s")).agg(*[F.avg(log_sum(i)).alias(f"_i{k}") for k, i in enumerate(identities)])
    names = sorted({c for i in identities for c in i})
    combos = list(itertools.product(*[sorted(columns[c]) for c in names]))

    def run(batches):
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                seen = [k for k in range(len(identities)) if rec[f"_i{k}"] == rec[f"_i{k}"] and rec[f"_i{k}"] is not None]
                scored = []
                for combo in combos if seen else []:
                    size = {c: math.log(columns[c][u]) for c, u in zip(names, combo)}
                    scored.append((math.sqrt(sum((rec[f"_i{k}"] + sum(e * size[c] for c, e in identities[k].items())) ** 2 for k in seen)), combo))
                scored.sort()
                for j, c in enumerate(names):
                    if not scored:
                        rows.append((rec["_s"], c, None, None, None, False))
                        continue
                    best, combo = scored[0]
                    unique = all(s > best + tolerance or other[j] == combo[j] for s, other in scored[1:])
                    rows.append((rec["_s"], c, combo[j], float(columns[c][combo[j]]), best, unique))
            yield pd.DataFrame(rows, columns=["source", "column", "unit", "factor", "log_residual", "unique_solution"])

    kind = df.schema[source].dataType.simpleString()
    return means.mapInPandas(run, f"source {kind}, column string, unit string, factor double, log_residual double, unique_solution boolean")
