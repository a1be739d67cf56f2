"""Column expressions for text: normalisation, tokens, evidence tests."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands for "nothing" in raw cells.
PLACEHOLDERS = ["-- Unbranded --", "-- No Unilog Brand --", "-- No DIB Brand --"]
# Words with opposite meaning, one of which in evidence contradicts the other in a value.
ANTONYMS = [("corded", "cordless"), ("brushless", "brushed"), ("indoor", "outdoor"), ("included", "not included"), ("yes", "no"), ("true", "false")]


def strip(c: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")


def normalized(c: Column) -> Column:
    """Struct (normalized, reason): null, blank and placeholder cells become null, each with its own reason."""
    s = strip(c)
    return F.struct(
        F.when(c.isNull() | (s == "") | s.isin(PLACEHOLDERS), F.lit(None).cast("string")).otherwise(s).alias("normalized"),
        F.when(c.isNull(), "null").when(s == "", "blank").when(s.isin(PLACEHOLDERS), "placeholder").when(s != c, "trimmed").otherwise(F.lit(None).cast("string")).alias("reason"),
    )


def nfkc(c: Column) -> Column:
    """Unicode compatibility form, which Spark has no function for."""
    from pyspark.sql import types as T

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return F.pandas_udf(run, T.StringType())(c)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


def canonical_key(c: Column) -> Column:
    """Lower case, runs of anything but letters, digits and underscores as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))


def identity_key(c: Column) -> Column:
    """Lower case letters and digits of the ASCII range only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def code_suffix(c: Column) -> Column:
    """The code in brackets at the end of a name; null where there is none."""
    return F.nullif(F.regexp_extract(c, r"\(([A-Za-z0-9-]+)\)\s*$", 1), F.lit(""))


def without_code(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s*\([A-Za-z0-9-]+\)\s*$", ""))


def mpn_match(a: Column, b: Column) -> Column:
    """EXACT, NORMALIZED_EQUIVALENT, DIFFERENT or MISSING; never by substring."""
    x, y = F.regexp_replace(F.lower(a), r"[^\p{L}\p{N}]", ""), F.regexp_replace(F.lower(b), r"[^\p{L}\p{N}]", "")
    missing = a.isNull() | b.isNull() | (x == "") | (y == "")
    return F.when(missing, "MISSING").when(strip(a) == strip(b), "EXACT").when(x == y, "NORMALIZED_EQUIVALENT").otherwise("DIFFERENT")


def numbers_in(c: Column) -> Column:
    """The numbers of a text as written, thousands commas removed."""
    return F.regexp_extract_all(F.regexp_replace(c, r"([0-9]),([0-9]{3})", "$1$2"), F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))


def tokens(c: Column, at_least: int = 1) -> Column:
    return F.filter(F.split(canonical_key(c), " "), lambda w: F.length(w) >= at_least)


def overlap_share(a: Column, b: Column, at_least: int = 4) -> Column:
    """The share of the words of ``a`` (from ``at_least`` letters) that stand in ``b``; 0 where there are none."""
    words = F.array_distinct(tokens(a, at_least))
    hit = F.size(F.filter(words, lambda w: F.contains(F.lower(b), w)))
    return F.when(F.size(words) > 0, hit / F.size(words)).otherwise(F.lit(0.0))


def supports(value: Column, evidence: Column) -> Column:
    """How one piece of evidence bears on a value: CONTRADICTED, SUPPORTED, REJECTED or UNDECIDED."""
    v, e = F.lower(collapse(value)), F.lower(collapse(evidence))
    def holds(text: Column, term: str) -> Column:
        return F.concat(F.lit(" "), canonical_key(text), F.lit(" ")).contains(f" {term} ")
    clash = F.lit(False)
    for x, y in ANTONYMS:
        clash = clash | (holds(v, x) & holds(e, y) & ~holds(e, x)) | (holds(v, y) & holds(e, x) & ~holds(e, y))
    wanted, there = numbers_in(v), numbers_in(e)
    numbered = F.size(wanted) > 0
    words = tokens(v, 3)
    return (
        F.when(value.isNull() | evidence.isNull() | (v == ""), "UNDECIDED").when(clash, "CONTRADICTED").when(e.contains(v), "SUPPORTED")
        .when(numbered & (F.size(F.array_except(wanted, there)) == 0), "SUPPORTED").when(numbered, "REJECTED")
        .when((F.size(words) > 0) & F.forall(words, lambda w: F.contains(e, w)), "SUPPORTED").otherwise("UNDECIDED")
    )


def truncate_words(parts: Column, limit: int, sep: str = ", ") -> Column:
    """As many leading parts joined as fit the limit, then a hard cut."""
    joined = F.aggregate(parts, F.lit(""), lambda acc, x: F.when(acc == "", x).when(F.length(acc) + F.length(x) + len(sep) <= limit, F.concat(acc, F.lit(sep), x)).otherwise(acc))
    return F.rtrim(F.substring(joined, 1, limit))


def context_tokens(c: Column) -> Column:
    """A rough token count of a prompt: a quarter of its length, at least 1."""
    return F.greatest(F.lit(1), F.floor((F.length(c) + 3) / 4)).cast("bigint")


def any_of(c: Column, fragments: Sequence[str]) -> Column:
    """True where the lower-cased text holds one of the fragments."""
    return F.exists(F.array(*[F.lit(f) for f in fragments]), lambda f: F.contains(F.lower(c), f))


def unfenced(c: Column) -> Column:
    """The JSON text inside a code fence or behind other words: from the first brace or bracket to the last one that can close it."""
    inner = F.regexp_extract(c, r"(?s)```(?:[a-zA-Z]+)?\s*\n(.*)\n\s*```", 1)
    text = F.when(inner != "", inner).otherwise(c)
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)([\[{].*[\]}])", 1), F.lit("")), text)
