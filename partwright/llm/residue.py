"""Template residue, filler and error-page text among values.

Work is done on distinct values.  Each is cut into units (the value, and for titles the parts between
separators), decoration is stripped and numbers are masked.  Unfilled placeholders of template languages
are told by their syntax; all wording is told from a small list of trusted phrases, through near-duplicate
links: SimHash fingerprints are kept in partitioned tables, a labelled unit probes each table with its key
and all keys one bit away, what it meets is verified by Hamming distance and then by text similarity, and a
breadth-first walk from the trusted phrases reaches all members of their connected components, round by
round, without ever listing pairs between units that no label can reach.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwright.session import broadcast_if_small, cut, join_values, spread

# Similarity from which units are linked: 1 - edits / length of the longer unit.
MIN_SIMILARITY = 0.85
# The fingerprint: tables of so many bits each, and the share of differing bits up to which texts are compared.
TABLES, TABLE_BITS, MAX_SHARE = 16, 16, 0.36
BITS = TABLES * TABLE_BITS
# Feature slots of the random signs behind the fingerprint.
_SLOTS = 1 << 13

# Placeholders as template languages write them.
TEMPLATE = [
    r"\{\{.*?\}\}", r"\$\{[^}]*\}", r"#\{[^}]*\}", r"\{\d+\}", r"<%.*?%>", r"<\?(?:php|=).*", r"%[a-z][a-z_.]*%", r"@@[\w.]+@@", r"__[a-z][a-z_.]*__", r"\$\$[\w.]+\$\$",
    r"«[\w.]+»", r"(?<![\w%])%[sd](?!\w)", r"\[(?:insert\b[^\]]*|(?:product|brand|item|page|site|mfr|manufacturer|company|title|name|your)(?:[ ._-]?\w+){0,2})\]",
    r"<(?:mfr|brand|title|name|item|product|manufacturer|page)[\w.]*>", r"\[object \w+\]", r"#(?:ref|value|n/a|name\?|null|div/0)!?", r"&lt;%",
]
# Trusted phrases, of which only spellings, decorations, numbers and surroundings vary.
TRUSTED = [
    "unbranded", "no brand", "no brand name", "no dib brand", "no unilog brand", "no e1 brand", "brand pending", "title pending", "enter brand", "select a brand", "choose a brand", "brand name here",
    "your brand here", "your title here", "your company name", "page title goes here", "title goes here", "headline goes here", "insert headline", "insert title", "insert text here", "untitled document", "untitled page", "untitled", "new page 1",
    "null", "undefined", "none", "nan", "nil", "n/a", "n.a", "tbd", "tba", "tbc", "unknown", "unknown brand", "not available", "not applicable", "not set", "not specified", "to be confirmed", "to be determined", "to be announced", "default",
    "todo", "fixme", "asdf", "asdf asdf", "xxx", "qwerty", "test", "test test", "foo bar", "foo", "dummy", "placeholder", "sample", "sample text", "test page please ignore", "test product", "sample product - do not publish", "please ignore", "do not publish",
    "lorem ipsum", "lorem ipsum dolor sit amet", "dolor sit", "dolor sit amet", "coming soon", "under construction", "this page is under construction",
    "error 404", "error code 404", "http 404", "http status 404", "status code 404", "http error 404", "404", "404 error", "404 not found", "not found", "page not found", "403 forbidden", "forbidden", "500 internal server error", "internal server error",
    "502 bad gateway", "bad gateway", "503 service unavailable", "service unavailable", "service temporarily unavailable", "504 gateway timeout", "gateway timeout", "too many requests", "page cannot be shown", "404 - page cannot be shown",
    "page cannot be displayed", "this page cannot be found", "we could not find that page", "we can't find the page you are looking for", "this page is no longer available", "this page does not exist", "the item you requested has been removed",
    "the page you requested has been removed", "this product is no longer available", "access denied", "access forbidden", "permission denied", "unauthorized", "request blocked", "you have been blocked", "session expired",
    "session expired, please sign in again", "please sign in", "please log in", "connection timed out", "connection refused", "request timed out", "oops! something went wrong", "something went wrong", "an error occurred", "an error has occurred",
    "fatal error: cannot load template", "fatal error", "exception in lookup_brand()", "unhandled exception", "cannot load page", "failed to load", "this site is down for maintenance", "down for maintenance", "under maintenance",
    "please enable javascript", "enable javascript", "please turn on javascript", "javascript is required", "javascript is disabled", "this site requires javascript", "please enable javascript to view this site",
    "please turn on javascript to view this site", "you need a browser with scripting switched on", "please enable cookies", "just a moment", "one moment please", "please wait", "loading", "redirecting", "checking your browser",
    "checking your browser before you go on", "checking your browser before accessing the site", "verify you are human", "verify that you are not a robot", "are you a robot", "are you human", "security check", "please complete the captcha",
]
_DECORATION = r"^[\s\-–—_*<>«»\"'()\[\]|=~#]+|[\s\-–—_*<>«»\"'()\[\]|=~#.!?…,;:]+$"


def core(text: Column) -> Column:
    """The text in lower case, without the signs that decorate it, numbers masked; '' where no letter is left.

    Single letters repeated count as three of them.
    """
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), r"^\s*<title>", ""), _DECORATION, ""), r"\s+", " ")
    masked = F.regexp_replace(F.regexp_replace(plain, r"\d+", "0"), r"^x{3,}$", "xxx")
    return F.when(masked.rlike(r"\p{L}") | plain.rlike(r"^[45]\d\d$"), masked).otherwise(F.lit(""))


def segments(text: Column) -> Column:
    """The parts of a title between separators."""
    return F.split(text, r"\s+[|»·•–—-]\s+|:\s+|\s+:|\s*\|\s*")


def units(text: Column, titled: Column) -> Column:
    """The cores that stand for a value: its own, and for titles those of their parts."""
    return F.array_distinct(F.when(titled, F.concat(F.array(core(text)), F.transform(segments(text), core))).otherwise(F.array(core(text))))


def unfilled(text: Column) -> Column:
    """True where the value holds a placeholder of a template language, or nothing but punctuation."""
    low = F.lower(text)
    return low.rlike("|".join(f"(?:{p})" for p in TEMPLATE)) | low.rlike(r"^<title>|^[\s?.!\-–—_*]+$")


@lru_cache(maxsize=1)
def _signs() -> np.ndarray:
    return np.random.default_rng(11).choice(np.array([-1, 1], dtype=np.int8), size=(_SLOTS, BITS))


def fingerprint(text: str) -> np.ndarray:
    """The bits of a text's SimHash over its letters and pairs of neighbouring letters, each weighted by its count.

    Short texts differ in few letters, of which each changes one single letter and two pairs at most.
    """
    padded = f"^{text}$"
    grams = [padded[i : i + 2] for i in range(len(padded) - 1)] + list(text)
    slots = [zlib.crc32(g.encode()) % _SLOTS for g in grams]
    return (_signs()[slots].sum(axis=0, dtype=np.int32) > 0).astype(np.uint8)


_POWERS = (1 << np.arange(TABLE_BITS)).astype(np.int64)


def table_keys(bits: np.ndarray) -> np.ndarray:
    """The key of each table: the table's number above its bits."""
    return bits.reshape(TABLES, TABLE_BITS) @ _POWERS + (np.arange(TABLES, dtype=np.int64) << TABLE_BITS)


def _words(bits: np.ndarray) -> list[int]:
    return np.packbits(bits).view(">i8").astype(np.int64).tolist()


def _index(batches):
    for pdf in batches:
        found = [fingerprint(u) for u in pdf["unit"]]
        yield pd.DataFrame({"unit": pdf["unit"], "print": [_words(b) for b in found], "keys": [table_keys(b).tolist() for b in found]})


def prints(units_: DataFrame) -> DataFrame:
    """``unit``, ``print`` (the bits in longs) and ``keys`` (one for each table) of distinct units."""
    return units_.select("unit").mapInPandas(_index, "unit string, print array<bigint>, keys array<bigint>")


def _hamming(a: Column, b: Column) -> Column:
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, BITS // 64)), F.bit_count(a[0].bitwiseXOR(b[0])))


def probes(keys: Column) -> Column:
    """The keys and all that differ from one of them in one bit."""
    near = F.transform(keys, lambda k: F.array(k, *[k.bitwiseXOR(F.lit(1 << b).cast("bigint")) for b in range(TABLE_BITS)]))
    return F.flatten(near)


def near_units(asked: DataFrame, tables: DataFrame) -> DataFrame:
    """``unit`` and ``print`` of the units in ``tables`` (unit, print, key) similar to one of ``asked`` (unit, print, keys)."""
    wanted = cut(asked.select(F.col("unit").alias("unit_f"), F.col("print").alias("print_f"), F.explode(probes(F.col("keys"))).alias("key")))
    met = tables.join(broadcast_if_small(wanted, wanted.count()), "key").filter(_hamming(F.col("print"), F.col("print_f")) <= int(BITS * MAX_SHARE))
    longer = F.greatest(F.length("unit"), F.length("unit_f"))
    return met.filter(F.levenshtein("unit", "unit_f") <= longer * (1 - MIN_SIMILARITY) + 1e-9).select("unit", "print").distinct()


def spread_labels(found: DataFrame, trusted: list[str] | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """``unit`` for each unit of ``found`` in a connected component that holds a trusted phrase or a unit of ``labelled``.

    Each round probes only with the units labelled in the round before; it ends when none is added.
    Blank units are in no component.  The fingerprints are written once to the shared folder.
    """
    spark = found.sparkSession
    seeds = spark.createDataFrame([(t,) for t in (TRUSTED if trusted is None else trusted)], "text string").select(core(F.col("text")).alias("unit"))
    if labelled is not None:
        seeds = seeds.unionByName(labelled.select("unit"))
    known = cut(found.filter("unit != ''").select("unit").distinct())
    index = cut(prints(spread(known, known.count())))
    tables = index.select("unit", "print", F.explode("keys").alias("key"))
    frontier = cut(prints(seeds.filter("unit != ''").distinct()))
    rounds: list[DataFrame] = []
    while frontier.count():
        new = near_units(frontier, tables).select("unit")
        for r in rounds:
            new = new.join(r, "unit", "left_anti")
        fresh = cut(new)
        rounds.append(fresh)
        frontier = cut(index.join(broadcast_if_small(fresh, fresh.count()), "unit", "left_semi"))
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def residue_values(distinct: DataFrame, trusted: list[str] | None = None) -> DataFrame:
    """The rows of ``distinct`` (titled boolean, value) that are residue."""
    values = cut(distinct.filter(F.trim(F.regexp_replace("value", r"\s+", " ")) != "").select("titled", "value", unfilled(F.col("value")).alias("unfilled"), units(F.col("value"), F.col("titled")).alias("units")))
    spread = values.filter("not unfilled").select("titled", "value", F.explode("units").alias("unit"))
    labelled = spread_labels(spread.select("unit"), trusted)
    told = spread.join(broadcast_if_small(labelled, labelled.count()), "unit", "left_semi").select("titled", "value")
    return values.filter("unfilled").select("titled", "value").unionByName(told.distinct())


def find_residue(tables: list[tuple[DataFrame, str, str, dict[str, bool]]]) -> DataFrame:
    """One row per residue value: ``table_name``, ``record_id``, ``field_name``.

    Each entry gives a frame, its name, its key and its fields (true for titles, which may hold residue
    in a part).  Null and blank values are no case; repeated rows come out each on their own; empty
    tables give none; extra columns are ignored.  Rows are reduced to distinct values before any
    shuffle, so that a value held by most rows costs one; the few residue values are joined back,
    broadcast when counted within the bound, beyond it with the commonest values kept out of the shuffle.
    """
    long = None
    for df, name, key, fields in tables:
        cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.lit(t).alias("titled"), F.col(f).alias("value")) for f, t in fields.items()])
        part = df.select(F.lit(name).alias("table_name"), F.col(key).cast("bigint").alias("record_id"), F.inline_outer(cells)).filter("value is not null and trim(value) != ''")
        long = part if long is None else long.unionByName(part)
    counted = cut(long.groupBy("titled", "value").agg(F.count(F.lit(1)).alias("n_rows")))
    bad = cut(residue_values(counted.select("titled", "value")).join(counted, ["titled", "value"]))
    total = counted.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("t")).first()["t"]
    return join_values(long, bad, ["titled", "value"], "n_rows", total).select("table_name", "record_id", "field_name")
