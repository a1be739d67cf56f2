"""Text cut off by field limits.

Three kinds of evidence, all computed row by row inside the JVM.  A stack automaton over brackets
and markup and double quotes, with checks for broken multibyte sequences, escapes and ellipses, finds
ends that no complete text has (single quotes are left out, being apostrophes and foot marks).  A
baseline of terminators for each source, learned from its values that are proven complete, finds
ends on which complete values do not stop.  And fields of one record that carry the same text show
each other's missing ends.  Only the counts of proven endings are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwright.session import broadcast_if_small, cut

# A token counts as terminator of a source when it ends at least this share of its proven complete values;
# there can be no more than 1 / MIN_SHARE terminators of a source.
MIN_SHARE = 2e-4
# A terminator of all sources together holds for a source as long as fewer endings with it than this were to be expected there.
EXPECTED = 20
# Shortest common text by which two fields of a record are aligned.
MIN_ALIGN = 8
# Ends left by a cut inside an escape, an entity, a tag or a multibyte sequence, or put in place of the lost end.
BROKEN_END = r"(?:\s*(?:\.\.\.|…)|�+|&(?:[a-z]{1,7}|#[0-9a-fx]*)?|<[/!]?[a-z0-9]*(?: [^<>]*)?|\\(?:u[0-9a-f]{0,3}|x[0-9a-f]?)?|%[0-9a-f]?(?![^%]))$"
# Signs without which the longer expression need not be tried.
_SUSPECT = r"[&<\\%…�]|\.\.\.$"
_OPENING_QUOTE = r'(?<![^\s(\[{])"(?=[^\s"])'
# What may follow the common text: a reference in brackets, or a clause behind a comma that a short word opens and a full stop ends.
_PARTIAL_SUFFIX = r"(?:\s*\([^()]*\)?|,(?: [a-z]{1,4}(?: .*)?)?)$"
_WHOLE_SUFFIX = r"^(?: \([^()\s][^()]*\)|, [a-z]{1,4} .+\.)$"
_DONE = r"\S \([^()\s][^()]*\)$|, [a-z]{1,4} .+\.$"


def unclosed(text: Column) -> Column:
    """True where a bracket, tag or double quote is still open at the end: a pushdown automaton over the opening and closing signs.

    A quote opens before a word only; elsewhere it closes an open one or is an inch mark.
    """
    turned = F.when(text.rlike(_OPENING_QUOTE), F.regexp_replace(F.regexp_replace(text, _OPENING_QUOTE, "“"), '"', "”")).otherwise(text)
    signs = F.regexp_extract_all(turned, F.lit(r"[()\[\]{}“”]|<[a-zA-Z/!][^<>]*>?"), F.lit(0))
    kind = lambda t: (
        F.when(t.isin("(", ")"), F.lit("(")).when(t.isin("[", "]"), F.lit("[")).when(t.isin("{", "}"), F.lit("{")).when(t.isin("“", "”"), F.lit("“")).otherwise(F.lower(F.regexp_extract(t, r"^</?([a-zA-Z0-9]*)", 1)))
    )

    def step(stack: Column, t: Column) -> Column:
        closing = t.isin(")", "]", "}", "”") | t.startswith("</")
        void = t.startswith("<") & (t.endswith("/>") | t.startswith("<!") | kind(t).isin("br", "hr", "img", "meta", "link", "input"))
        open_tag = t.startswith("<") & ~t.endswith(">")
        popped = F.when(F.try_element_at(stack, F.lit(-1)).eqNullSafe(kind(t)), F.slice(stack, 1, F.size(stack) - 1)).otherwise(stack)
        return F.when(open_tag, F.concat(stack, F.array(F.lit("<")))).when(void, stack).when(closing, popped).otherwise(F.concat(stack, F.array(kind(t))))

    return F.when(text.rlike(r"[(\[{<“]|" + _OPENING_QUOTE), F.size(F.aggregate(signs, F.array().cast("array<string>"), step)) > 0).otherwise(F.lit(False))


def broken_end(text: Column) -> Column:
    """True where the text ends inside an escape, entity, tag or multibyte sequence, in an ellipsis, or with a bracket or quote open."""
    return F.when(text.rlike(_SUSPECT), F.lower(text).rlike(BROKEN_END)).otherwise(F.lit(False)) | unclosed(text)


def last_token(text: Column) -> Column:
    """The last word in lower case without closing punctuation."""
    return F.regexp_replace(F.substring_index(F.lower(F.rtrim(text)), " ", -1), r"[.,;:!?)\]]+$", "")


def _plain(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.nullif(F.when(low.rlike(_SUSPECT), F.trim(F.regexp_replace(low, BROKEN_END, ""))).otherwise(low), F.lit(""))


def _from(text: Column, base: Column) -> Column:
    """The text from where the base begins; null where it does not occur or is too short to align by."""
    at = F.instr(text, base)
    return F.when((F.length(base) >= MIN_ALIGN) & (at > 0), F.substring(text, at, F.length(text)))


def completeness(df: DataFrame, base: str, carriers: dict[str, bool], reference: str | None, part_number: str | None) -> DataFrame:
    """The rows with ``_evidence``, an array of (field, broken, cut, proven, token) per field that is not blank.

    ``base`` is the field whose text the ``carriers`` repeat at their end; a carrier marked true may go on
    with a reference in brackets or a seller's sentence.  ``reference`` repeats the base behind the part number.
    """
    b, num = _plain(F.col(base)), F.lower(F.trim(F.col(part_number))) if part_number else F.lit(None).cast("string")
    cols = {"_b": b, "_num": num, **{f"_c_{c}": _plain(F.col(c)) for c in carriers}}
    rows = df.withColumns(cols)
    if reference:
        r = F.lower(F.trim(F.col(reference)))
        at = F.instr(r, F.concat(F.col("_num"), F.lit(", ")))
        tail = F.when(at > 0, F.substring(r, at + F.length("_num") + 2, F.length(r))).otherwise(F.regexp_extract(r, r"^[^,]*, (.+)$", 1))
        rows = rows.withColumn("_r", F.nullif(_plain(tail), F.lit("")))
    else:
        rows = rows.withColumn("_r", F.lit(None).cast("string"))
    rows = rows.withColumn("_a", F.coalesce("_b", "_r"))
    tails = [F.regexp_replace(_from(F.col(f"_c_{c}"), F.col("_a")), _PARTIAL_SUFFIX if more else r"^$", "") for c, more in carriers.items()]
    heard = [F.col("_b"), F.when(F.col("_b").isNull() | F.startswith("_r", F.col("_b")), F.col("_r")), *tails]
    rows = rows.withColumn("_full", F.array_max(F.transform(F.array(*heard), lambda x: F.struct(F.coalesce(F.length(x), F.lit(-1)).alias("n"), x.alias("t"))))["t"])

    def verdict(field: str, plain: Column, lost: Column, proven: Column, token_of: Column) -> Column:
        raw = F.trim(F.col(field))
        return F.when(
            F.col(field).isNotNull() & (raw != ""),
            F.struct(F.lit(field).alias("field"), broken_end(raw).alias("broken"), F.coalesce(lost, F.lit(False)).alias("cut"), F.coalesce(proven, F.lit(False)).alias("proven"), last_token(token_of).alias("token")),
        )

    full = F.col("_full")
    out = [verdict(base, F.col("_b"), F.col("_b") != full, F.col("_b") == F.col("_r"), F.trim(F.col(base)))]
    for c, more in carriers.items():
        text = F.col(f"_c_{c}")
        rest = F.substring(text, F.instr(text, full) + F.length(full), F.length(text))
        head = F.substring(text, F.lit(1), F.instr(text, full) - 1)
        has = (F.length(full) >= MIN_ALIGN) & (F.instr(text, full) > 0)
        usable = full.isNotNull() & (F.length(full) >= MIN_ALIGN)
        if more:
            numbered = F.coalesce(F.endswith(head, F.concat(F.col("_num"), F.lit(" "))), F.lit(True))
            good = has & (rest.rlike(_WHOLE_SUFFIX) | ((rest == "") & numbered))
            done = text.rlike(_DONE)
            out.append(verdict(c, text, usable & ~good & ~done, done | (usable & good & full.eqNullSafe(F.col("_r"))), F.when(done, F.lit(")")).otherwise(F.trim(F.col(c)))))
        else:
            # only the reference bears witness: other fields are cut at the same place where their limits agree
            out.append(verdict(c, text, usable & ~F.endswith(text, full), usable & F.endswith(text, full) & full.eqNullSafe(F.col("_r")), F.trim(F.col(c))))
    return rows.withColumn("_evidence", F.filter(F.array(*out), lambda x: x.isNotNull()))


def terminators(flat: DataFrame, source: str) -> DataFrame:
    """The tokens on which proven complete values of each source end: ``source``, ``token``.

    A source's own endings count by their share in it.  Terminators of all sources together are added
    unless the source has proven endings enough to show that it does not use them.
    """
    proven = F.col("proven") & (F.col("token") != "") & (F.col("token") != ")")
    ends = cut(flat.filter(proven).groupBy(source, "token").agg(F.count(F.lit(1)).alias("n")))
    sources = flat.groupBy(source).agg(F.sum(proven.cast("bigint")).alias("t"))
    total = ends.agg(F.sum("n").alias("t"))
    both = ends.groupBy("token").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(total))
    pooled = both.filter((F.col("n") >= 3) & (F.col("n") >= F.col("t") * MIN_SHARE)).select("token", (F.col("n") / F.col("t")).alias("q"))
    rows = ends.join(sources.withColumnRenamed(source, "_of"), F.col(source).eqNullSafe(F.col("_of"))).join(pooled, "token", "left")
    own = rows.filter((F.col("n") >= 3) & (F.col("q").isNotNull() | (F.col("n") >= F.col("t") * MIN_SHARE))).select(source, "token")
    lent = sources.crossJoin(pooled).filter(F.col("t") * F.col("q") < EXPECTED).select(source, "token")
    return cut(own.unionByName(lent).distinct())


def truncated(df: DataFrame, key: str, source: str, base: str, carriers: dict[str, bool], reference: str | None = None, part_number: str | None = None) -> DataFrame:
    """One row per value that is not blank: key, source, ``field_name``, ``is_cut`` and the evidence.

    Null and blank values give no row, an empty table an empty result; repeated rows are judged each on
    their own; extra columns are ignored.  Without any proven complete value only the automaton and the
    fields of the same record decide.  The evidence, a few flags per value, is written once to the
    shared folder, since the baseline and the result both read it.
    """
    names = [key, source, base, *carriers, *([reference] if reference else []), *([part_number] if part_number else [])]
    rows = completeness(df.select(*dict.fromkeys(names)), base, carriers, reference, part_number)
    # inline_outer, since inline would infer a filter and push a copy of the whole evidence below every projection
    flat = cut(rows.select(key, source, F.inline_outer("_evidence"))).filter("field is not null")
    ends = terminators(flat, source)
    n = ends.count()
    known = broadcast_if_small(ends.select(F.col(source).alias("_of"), F.col("token").alias("_end")), n)
    unknown = F.col("_end").isNull() & (F.col("token") != ")") if n else F.lit(False)
    flat = flat.join(known, F.col(source).eqNullSafe(F.col("_of")) & (F.col("token") == F.col("_end")), "left")
    return flat.select(key, source, F.col("field").alias("field_name"), (F.col("broken") | F.col("cut") | (~F.col("proven") & unknown)).alias("is_cut"), "broken", "cut", "proven", "token")
