"""Free-typed names mapped to a canonical list.

Values are reduced to distinct ones and cut into tokens.  Each distinct token is joined to the
reference vocabulary by edit distance, through the variants that remain when up to two letters are
deleted, which is an equality join and finds every pair within two edits.  Corrected tokens are then
combined with soft TF-IDF to rank whole entries, scored over all their tokens: those that share a telling
token with the value, and those without a telling word which it shares most words with.  The latter are found exactly,
through those of an entry's rarest words without which the rest of it weighs too little to count; so a
word which many entries share multiplies values only with entries that hold hardly anything else.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partwright.llm.residue import residue_values
from partwright.session import broadcast_if_small, cut, join_values, spread

UNMATCHED = "UNMATCHED"
# A token tells entries apart when it is this long and stands in no more than this many entries, and no more than a tenth of them if there are several.
DISTINCT_LENGTH, DISTINCT_ENTRIES = 5, 2
_ACCENTED = "áàâäãåéèêëíìîïóòôöõøúùûüýÿçñš" + "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕØÚÙÛÜÝŸÇÑŠ"
_BARE = "aaaaaaeeeeiiiioooooouuuuyycns" + "AAAAAAEEEEIIIIOOOOOOUUUUYYCNS"
# An entry is named when the value holds at least this share of its weight, the squares of its tokens' inverse document frequencies.
MIN_COVER = 1 / 3
# Without a telling token the words found must hold at least this share of the weight of the entry and of the value alike.
MIN_BOTH = 0.6
# Tokens longer than this are cut into pieces instead of deleting letters from them.
LONG = 40
# Digits typed for letters.
_DIGITS, _LETTERS = "013457", "oieast"
# Remarks around a name that are no part of it.
_REMARKS = r"\*[^*]*\*|\bc/o\b.*$|\s/\s.*\bdept\b.*$|\s[-–—]\s*do not use\b.*$|[™®©]|\([^()]*\)|[\"'“”‘’`]"
_LABEL = r"^\s*(?:brand|mfr|mfg|maker|manufacturer|vendor|code)\s*[:.#]?\s+|^\s*brand:"


def exact_key(value: Column) -> Column:
    """The value in lower case, without accents, remarks and labels, blanks collapsed."""
    plain = F.lower(F.translate(value, _ACCENTED, _BARE))
    plain = F.regexp_replace(F.regexp_replace(plain, _REMARKS, " "), _LABEL, "")
    return F.regexp_replace(F.trim(F.regexp_replace(plain, r"\s+", " ")), r"[.,;]+$", "")


def bracket_code(value: Column) -> Column:
    """The code in brackets at the end, in lower case; '' where there is none."""
    return F.lower(F.regexp_extract(value, r"\(\s*([A-Za-z0-9-]{3,8})\s*\)[^()]*$", 1))


def tokens(value: Column) -> Column:
    """The words of a value, digits typed for letters put right, and what adjacent words give when joined."""
    cased = F.regexp_replace(F.translate(value, _ACCENTED, _BARE), r"([a-z])([A-Z])", "$1 $2")
    low = F.regexp_replace(F.regexp_replace(F.lower(cased), _REMARKS, " "), _LABEL, "")
    words = F.filter(F.split(F.regexp_replace(low, r"[^a-z0-9]+", " "), " "), lambda w: w != "")
    return F.transform(words, lambda w: F.when(w.rlike("[a-z].*[a-z]") & w.rlike("[0-9]"), F.translate(w, _DIGITS, _LETTERS)).otherwise(w))


def with_joins(words: Column) -> Column:
    n = F.size(words)
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.element_at(words, i), F.element_at(words, i + 1))))
    return F.array_distinct(F.concat(words, F.coalesce(pairs, F.array().cast("array<string>")), F.array(F.array_join(words, ""))))


def deletions(token: Column) -> Column:
    """The token and all that remains of it with one or two letters deleted."""
    def less(t: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))

    one = F.when(F.length(token) >= DISTINCT_LENGTH, less(token)).otherwise(F.array().cast("array<string>"))
    two = F.when(F.length(token) >= 7, F.flatten(F.transform(one, less))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(token), one, two))


def edits(a: str, b: str) -> int:
    """Edit distance with neighbouring letters swapped counted as one edit."""
    if a == b:
        return 0
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, prev2[j - 2] + 1)
            row.append(best)
        prev2, prev = prev, row
    return prev[-1]


def _verify(batches):
    distance = lru_cache(maxsize=200_000)(edits)
    for pdf in batches:
        pdf = pdf.assign(n=[distance(t, r) for t, r in zip(pdf["token"], pdf["ref"])])
        size = pdf[["token", "ref"]].apply(lambda c: c.str.len()).min(axis=1) if len(pdf) else pd.Series(dtype=int)
        allowed = (size >= 7).astype(int) + (size >= DISTINCT_LENGTH).astype(int)
        yield pdf[pdf["n"] <= allowed]


def _long_pairs(found: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Candidate pairs of tokens longer than LONG: of three pieces of a reference one is unchanged, at most two places off."""
    n, m = F.length("token"), F.length("ref")
    cut_at = lambda size, i: F.floor(size * i / 3).cast("int")
    refs = vocabulary.filter(m > LONG - 2).select("ref", m.alias("m"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    refs = refs.select("ref", "m", "i", F.substring("ref", cut_at(F.col("m"), F.col("i")) + 1, cut_at(F.col("m"), F.col("i") + 1) - cut_at(F.col("m"), F.col("i"))).alias("v"))
    have = found.filter(n > LONG).select("token", F.explode(F.sequence(n - 2, n + 2)).alias("m")).select("token", "m", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    have = have.select("*", F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("d")).filter(cut_at(F.col("m"), F.col("i")) + F.col("d") >= 0)
    have = have.select("token", "m", "i", F.substring("token", cut_at(F.col("m"), F.col("i")) + F.col("d") + 1, cut_at(F.col("m"), F.col("i") + 1) - cut_at(F.col("m"), F.col("i"))).alias("v"))
    return have.join(refs, ["m", "i", "v"]).select("token", "ref")


def repair_tokens(found: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``token``, ``ref``, ``n``: every reference token within the edits its length allows (0, 1 from 5 letters, 2 from 7)."""
    have = found.filter(F.length("token") <= LONG).select("token", F.explode(deletions(F.col("token"))).alias("v"))
    refs = cut(vocabulary.filter(F.length("ref") <= LONG + 2).select("ref", F.explode(deletions(F.col("ref"))).alias("v")))
    pairs = have.join(broadcast_if_small(refs, refs.count()), "v").filter(F.abs(F.length("token") - F.length("ref")) <= 2).select("token", "ref")
    pairs = cut(pairs.unionByName(_long_pairs(found, vocabulary)).distinct())
    return spread(pairs, pairs.count()).withColumn("n", F.lit(0)).mapInPandas(_verify, "token string, ref string, n int")


def entries(registry: DataFrame) -> DataFrame:
    """One row per registry name: ``kind``, ``record_id``, ``name`` (canonical name and aliases)."""
    names = F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return registry.select(F.col("record_kind").alias("kind"), "record_id", F.explode(names).alias("name")).filter("trim(name) != ''")


def resolve_values(values: DataFrame, registry: DataFrame) -> DataFrame:
    """``kind``, ``value``, ``canonical_id`` for distinct (kind, value) pairs that are names.

    First codes and whole names decide; for the rest tokens are repaired and entries ranked by soft
    TF-IDF.  An entry of which a telling token was found counts if the tokens found hold at
    least MIN_COVER of its weight.  A name that has no telling word counts if they hold at least MIN_BOTH of
    its weight and of the value's, words that no entry has being the heaviest, and only where no telling token decides.  Ties
    go to the entry with fewer edits, then to the smaller id.  The registry's tokens are broadcast only
    after a count.
    """
    named = entries(registry)
    keys = named.select("kind", "record_id", exact_key(F.col("name")).alias("k")).unionByName(
        registry.select(F.col("record_kind").alias("kind"), "record_id", F.lower("code").alias("k"))
    )
    keys = keys.filter("k != ''").groupBy("kind", "k").agg(F.min("record_id").alias("hit"))
    n_keys = keys.count()
    small = lambda df: broadcast_if_small(df, n_keys)
    rows = values.select("kind", "value", exact_key(F.col("value")).alias("k"), bracket_code(F.col("value")).alias("b"))
    rows = rows.join(small(keys), ["kind", "k"], "left").withColumnRenamed("hit", "by_name")
    rows = cut(rows.join(small(keys.select("kind", F.col("k").alias("b"), F.col("hit").alias("by_code"))), ["kind", "b"], "left"))
    sure = rows.filter("by_code is not null or by_name is not null").select("kind", "value", F.coalesce("by_code", "by_name").alias("canonical_id"))
    rest = rows.filter("by_code is null and by_name is null").select("kind", "value")

    own, joined = tokens(F.col("name")), F.array_join(tokens(F.col("name")), "")
    words = named.select("kind", "record_id", "name", F.explode(F.array_distinct(own)).alias("ref"), F.lit(False).alias("joined"))
    words = words.unionByName(named.filter(F.size(own) > 1).select("kind", "record_id", "name", joined.alias("ref"), F.lit(True).alias("joined")))
    words = words.groupBy("kind", "record_id", "name", "ref").agg(F.min("joined").alias("joined"))
    sizes = registry.groupBy(F.col("record_kind").alias("kind")).agg(F.countDistinct("record_id").alias("n_records"))
    weights = words.groupBy("kind", "ref").agg(F.countDistinct("record_id").alias("df")).join(sizes, "kind")
    weighed = words.join(weights, ["kind", "ref"]).select("kind", "record_id", "name", "ref", "joined", F.log(1 + F.col("n_records") / F.col("df")).alias("w"), ((F.length("ref") >= DISTINCT_LENGTH) & (F.col("df") <= F.least(F.lit(DISTINCT_ENTRIES), F.greatest(F.lit(1), F.col("n_records") / 10)))).alias("telling"))
    index = cut(weighed)
    n_index = index.count()
    # a name's weight is that of its words; a name written as one word holds all of it
    weight = F.when(F.col("joined"), 0.0).otherwise(F.col("w") * F.col("w"))
    norms = index.groupBy("kind", "record_id", "name").agg(F.sqrt(F.sum(weight)).alias("norm"))
    # of a name without a telling word those words that, with all lighter ones, can still hold MIN_BOTH of the entry
    name = Window.partitionBy("kind", "record_id", "name")
    lighter = F.sum(weight).over(name.orderBy("w", F.col("ref").desc()).rowsBetween(Window.unboundedPreceding, 0))
    leading = ~F.max(F.col("telling") & ~F.col("joined")).over(name) & (F.col("joined") | (lighter >= (MIN_BOTH - 1e-9) * F.sum(weight).over(name)))

    cells = rest.select("kind", "value", F.explode(with_joins(tokens(F.col("value")))).alias("token"))
    counted = cut(cells.groupBy("token").agg(F.count(F.lit(1)).alias("n_cells")))
    repaired = cut(repair_tokens(counted.select("token"), index.select("ref").distinct()).join(counted, "token"))
    total = counted.agg(F.coalesce(F.sum("n_cells"), F.lit(0)).alias("t")).first()["t"]
    soft = cut(join_values(cells, repaired, ["token"], "n_cells", total).groupBy("kind", "value", "ref").agg(F.min("n").alias("n")))
    rare = index.withColumn("leading", leading).filter("telling or leading").select("kind", "ref", "record_id", "name", "telling")
    candidates = soft.join(broadcast_if_small(rare, n_index), ["kind", "ref"]).groupBy("kind", "value", "record_id", "name").agg(F.max("telling").alias("told"))
    parts = candidates.join(broadcast_if_small(index.join(norms, ["kind", "record_id", "name"]), n_index), ["kind", "record_id", "name"]).join(soft, ["kind", "value", "ref"])
    likeness = 1 - F.col("n") / F.greatest(F.length("ref"), F.lit(1))
    square = F.col("norm") * F.col("norm")
    ranked = parts.groupBy("kind", "value", "record_id", "name", "norm", "told").agg(
        F.greatest(F.sum(F.when(F.col("joined"), 0.0).otherwise(likeness * F.col("w") * F.col("w"))), F.max(F.when(F.col("joined"), likeness * square).otherwise(0.0))).alias("s"), F.sum("n").alias("n")
    )
    ranked = cut(ranked.filter(F.col("s") >= F.when(F.col("told"), MIN_COVER).otherwise(MIN_BOTH) * square).withColumn("score", F.col("s") / F.col("norm")))
    told, untold = ranked.filter("told"), ranked.filter("not told")
    open_values = cut(untold.select("kind", "value").distinct().join(told.select("kind", "value").distinct(), ["kind", "value"], "left_anti"))
    own_words = open_values.select("kind", "value", F.explode(F.array_distinct(tokens(F.col("value")))).alias("token"))
    known = own_words.select("token").distinct().join(repaired, "token").join(index.select("kind", "ref", "w").distinct(), "ref").groupBy("kind", "token").agg(F.max("w").alias("w"))
    heaviest = F.log(1 + F.col("n_records"))
    heavy = own_words.join(known, ["kind", "token"], "left").join(F.broadcast(sizes), "kind").withColumn("w", F.coalesce("w", heaviest)).groupBy("kind", "value").agg(F.sum(F.col("w") * F.col("w")).alias("whole"))
    ranked = told.unionByName(untold.join(heavy, ["kind", "value"]).filter(F.col("s") >= MIN_BOTH * F.col("whole")).drop("whole"))
    top = Window.partitionBy("kind", "value").orderBy(F.col("score").desc(), "n", "record_id")
    chosen = ranked.withColumn("_r", F.row_number().over(top)).filter("_r = 1").select("kind", "value", F.col("record_id").alias("canonical_id"))
    other = rest.join(chosen, ["kind", "value"], "left").select("kind", "value", F.coalesce("canonical_id", F.lit(UNMATCHED)).alias("canonical_id"))
    return sure.unionByName(other)


def map_names(df: DataFrame, key: str, fields: dict[str, str], registry: DataFrame) -> DataFrame:
    """One row per value that names or codes an entry of its kind: key, ``field_name``, ``canonical_id`` or UNMATCHED.

    ``fields`` maps a column to the registry kind.  Nulls, blanks and residue (placeholders, filler,
    error notices) give no row; an empty registry gives UNMATCHED for every name; repeated rows come
    out each on their own; extra columns are ignored.  Work is done on distinct values, counted before
    any shuffle; values that hold many rows are joined back by broadcast.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.lit(k).alias("kind"), F.col(f).alias("value")) for f, k in fields.items()])
    long = df.select(F.col(key), F.inline_outer(cells)).filter("value is not null and trim(value) != ''")
    distinct = cut(long.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n_rows")))
    worded = distinct.filter(F.col("value").rlike(r"[\p{L}\p{N}]"))
    bad = cut(residue_values(worded.select(F.lit(False).alias("titled"), "value").distinct()).select("value"))
    names = cut(worded.join(broadcast_if_small(bad, bad.count()), "value", "left_anti"))
    solved = cut(resolve_values(names.select("kind", "value"), registry).join(names, ["kind", "value"]))
    total = solved.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("t")).first()["t"]
    return join_values(long, solved, ["kind", "value"], "n_rows", total).select(key, "field_name", "canonical_id")
