"""Column expressions for part numbers, hashes and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELD_MARK = "\u001f"


def row_hash(*cells: Column) -> Column:
    """SHA-256 over the cells joined by a unit separator, null as empty."""
    return F.sha2(F.concat_ws(FIELD_MARK, *[F.coalesce(c.cast("string"), F.lit("")) for c in cells]), 256)


def fingerprint(*parts: Column, sep: str = "|") -> Column:
    return F.sha2(F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


# The kinds of hypotheses with their confidence and whether they may prove an identity.
RAW = ("raw", 1.0, True)
LOSSLESS = ("lossless_normalized", 0.98, True)
VERIFIED = ("verified_manufacturer_transform", 0.90, True)
PREFIX = ("exploratory_prefix_strip", 0.50, False)
NUMERIC = ("exploratory_numeric_extraction", 0.40, False)
COMPACT = ("exploratory_compact", 0.35, False)
# Makers whose distributor prefixes and item ids are known.
KNOWN_MAKERS = ["3m", "jam industrial"]


def mpn_hypotheses(mpn: Column, maker: Column | None = None) -> Column:
    """What a part number may be: array of (value, kind, confidence, lossless, identity_eligible, rule), in order, no value twice apart from case.

    ``maker`` names the maker, if known; for makers of KNOWN_MAKERS prefixes and item ids are verified
    transformations, else they are for search only.  Null and blank part numbers give null.
    """
    raw = F.regexp_replace(mpn, r"^\s+|\s+$", "")
    hint = F.lower(F.coalesce(maker, F.lit(""))) if maker is not None else F.lit("")
    known_maker = F.exists(F.array(*[F.lit(k) for k in KNOWN_MAKERS]), lambda k: F.contains(hint, k))
    head, tail = (F.regexp_extract(raw, r"^([A-Za-z0-9]{2,6})[-_]([A-Za-z0-9._/-]+)$", i) for i in (1, 2))
    bare, bare_tail = (F.regexp_replace(c, r"[-_\s/.]+", "") for c in (raw, tail))
    known_prefix = known_maker & (F.startswith(F.upper(head), F.lit("3M")) | tail.rlike(r"^\d{8,10}$"))
    ids = F.regexp_extract_all(raw, F.lit(r"\b(\d{8,10})\b"), F.lit(1))

    def one(value: Column, kind: tuple[str, float, bool], rule: str, lossless: bool = False) -> Column:
        return F.struct(value.alias("value"), F.lit(kind[0]).alias("kind"), F.lit(kind[1]).alias("confidence"), F.lit(lossless).alias("lossless"), F.lit(kind[2]).alias("identity_eligible"), F.lit(rule).alias("rule"))

    first = F.array(
        one(raw, RAW, "raw_input", True),
        F.when((F.length(bare) >= 3) & (bare != raw), one(bare, LOSSLESS, "lossless_separator_removal", True)),
        F.when(F.length(tail) >= 3, F.when(known_prefix, one(tail, VERIFIED, "known_3m_distributor_prefix")).otherwise(one(tail, PREFIX, "generic_prefix_strip"))),
    )
    found = F.transform(ids, lambda d: F.when(known_maker, one(d, VERIFIED, "known_3m_numeric_id")).otherwise(one(d, NUMERIC, "generic_numeric_core")))
    last = F.array(F.when(tail.rlike(r"[-_\s/.]") & (F.length(bare_tail) >= 3), one(bare_tail, COMPACT, "exploratory_compact")))
    every = F.array_compact(F.concat(first, found, last))
    fresh = lambda x, i: ~F.exists(F.slice(every, F.lit(1), i), lambda y: F.lower(y["value"]) == F.lower(x["value"]))
    return F.when(raw != "", F.filter(every, fresh))
