"""Several values packed in one field: split by delimiter skeletons.

Every value is cut into tokens, each token masked by its class; the sequence of classes is the
value's skeleton.  Values are many, skeletons few: the splitting rule is worked out once for each
distinct skeleton and joined back, and the values themselves are cut by position inside the JVM.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwright.session import cut, join_values

# The signs that part one value from the next, longest first.
DELIMITERS = ["->", ">>", "::", ">", "|", "/", "\\", ",", ";", "»", "~", "\t"]
QUOTES = "\"'"
# Order in which delimiters are tried where no known name shows which one counts.
PRECEDENCE = ["->", ">>", "::", "»", ">", "|", "~", "\t", ";", "\\", "/", ","]

_SPECIAL = "".join(sorted({c for d in DELIMITERS for c in d if not c.isalnum()} - {"-"}))


def _java(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != " " and ord(c) < 128 else c for c in text)


def _known_pattern(name: str) -> str:
    """A known name as it may be written: signs escaped by a backslash, double quotes doubled, spaces of any width."""
    out = []
    for c in name:
        if c == '"':
            out.append('(?:\\\\"|"{1,2})')
        elif c == " ":
            out.append(" +")
        elif c.isalnum():
            out.append(c)
        else:
            out.append("(?:\\\\)?" + _java(c))
    return "".join(out)


def token_pattern(known: list[str]) -> str:
    """The token expression: known names first, then escapes, doubled quotes, delimiters, quotes, space, other text."""
    stop = "[\\s" + _java(_SPECIAL + QUOTES) + "-]"
    parts = []
    if known:
        names = "|".join(_known_pattern(n) for n in sorted(known, key=lambda n: (-len(n), n)))
        parts.append(f"(?:{names})(?=$|{stop})")
    parts += ["\\\\[" + _java(_SPECIAL.replace("\\", "")) + "]", '""']
    parts += [_java(d) for d in DELIMITERS]
    parts += [f"[{_java(QUOTES)}]", "[ \\u00a0\\r\\n]+", "[^\\s" + _java(_SPECIAL + QUOTES) + "-]+", "-", "\\s"]
    return "|".join(parts)


def token_class(token: Column, known: list[str]) -> Column:
    """N for a known name, a for other text, one blank for space, the token itself for every sign."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "\\\\(?=.)", ""), '""', '"'), " +", " ")
    out = F.when(token.isin(*DELIMITERS), token).when(token.isin('"', "'", '""'), token)
    if known:
        out = out.when(plain.isin(*known), F.lit("N"))
    return (
        out.when(token.startswith("\\"), F.lit("\\e"))
        .when(F.trim(F.translate(token, "\u00a0\r\n", "   ")) == "", F.lit(" "))
        .otherwise(F.lit("a"))
    )


def resolve_skeleton(classes: list[str]) -> tuple[list[list[int]], list[str]]:
    """Segments of a skeleton as [first token, tokens, quote class], and the delimiters that were taken to part them.

    A quote opens a segment only where nothing but space stands before it in the segment, and closes
    it only where nothing but space stands between it and the next delimiter or the end.  Delimiters
    beside known names count; where there is none, the first of PRECEDENCE that occurs counts.
    """
    n = len(classes)
    opened: dict[int, int] = {}
    i, fresh = 0, True
    while i < n:
        c = classes[i]
        if c in ('"', "'") and fresh:
            j = i + 1
            while j < n:
                if classes[j] == c:
                    k = j + 1
                    while k < n and classes[k] == " ":
                        k += 1
                    if k == n or classes[k] in DELIMITERS:
                        break
                j += 1
            if j < n:
                opened[i] = j
                i, fresh = j + 1, False
                continue
        fresh = c in DELIMITERS or (fresh and c == " ")
        i += 1
    covered = set()
    for a, b in opened.items():
        covered.update(range(a, b + 1))
    marks = [i for i, c in enumerate(classes) if c in DELIMITERS and i not in covered]

    def solid(i: int, step: int) -> str:
        i += step
        while 0 <= i < n and classes[i] == " ":
            i += step
        if not 0 <= i < n:
            return "edge"
        return "N" if classes[i] == "N" or i in covered else "d" if classes[i] in DELIMITERS else classes[i]

    sure = {i for i in marks if solid(i, -1) in ("N", "d", "edge") and solid(i, 1) in ("N", "d", "edge")}
    kinds = {classes[i] for i in sure if "N" in (solid(i, -1), solid(i, 1))} or {
        classes[i] for i in marks if "N" in (solid(i, -1), solid(i, 1))
    }
    if not kinds:
        kinds = {next((d for d in PRECEDENCE if any(classes[i] == d for i in marks)), "")}
    cuts = [i for i in marks if i in sure or classes[i] in kinds]
    out, at = [], 0
    for end in [*cuts, n]:
        a, b = at, end
        while a < b and classes[a] == " ":
            a += 1
        while b > a and classes[b - 1] == " ":
            b -= 1
        quote = 0
        if b - a >= 2 and opened.get(a) == b - 1:
            quote = 1 if classes[a] == '"' else 2
            a, b = a + 1, b - 1
        if b > a:
            out.append([a + 1, b - a, quote])
        at = end + 1
    return out, sorted({classes[i] for i in cuts})


def _rules(batches):
    for pdf in batches:
        found = [resolve_skeleton(x.split("\u0001")) for x in pdf["skeleton"]]
        yield pd.DataFrame({"skeleton": pdf["skeleton"], "values": pdf["values"], "segments": [f[0] for f in found], "delimiters": [f[1] for f in found]})


def tokenised(df: DataFrame, value: str, known: list[str]) -> DataFrame:
    """The rows whose ``value`` is not blank, with ``_tokens`` and ``_skeleton``."""
    tokens = F.coalesce(F.regexp_extract_all(F.col(value), F.lit(token_pattern(known)), F.lit(0)), F.array().cast("array<string>"))
    rows = df.filter(F.trim(F.col(value)) != "").withColumn("_tokens", tokens)
    classes = F.transform("_tokens", lambda t: token_class(t, known))
    return rows.withColumn("_skeleton", F.coalesce(F.array_join(classes, "\u0001"), F.lit("")))


def splitting_rules(df: DataFrame, value: str, known: list[str]) -> DataFrame:
    """One row per distinct skeleton: how many values have it, its segments and its delimiters."""
    distinct = tokenised(df.select(value), value, known).groupBy(F.col("_skeleton").alias("skeleton")).agg(F.count(F.lit(1)).alias("values"))
    return distinct.mapInPandas(_rules, "skeleton string, values bigint, segments array<array<int>>, delimiters array<string>")


def split_packed(df: DataFrame, key: str, value: str, known: list[str]) -> DataFrame:
    """One row per value packed in ``value``: the key, ``node_no`` from 1 and ``node_value``.

    Values come out trimmed and without the quoting or escaping that only protects them.  Null and
    blank fields give no row, empty values are neither given nor counted, repeated rows are split
    each on their own, other columns are ignored, an empty table gives an empty result.  ``known``
    lists names that may hold delimiters.  The rules are as many as there are skeletons; they are
    written once, counted, and broadcast only within the bounds of ``session``; beyond them common
    skeletons are kept out of the shuffle.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    rules = cut(splitting_rules(rows, "_value", known).select(F.col("skeleton").alias("_skeleton"), "segments", "values"))
    total = rules.agg(F.coalesce(F.sum("values"), F.lit(0)).alias("t")).first()["t"]
    cells = tokenised(rows, "_value", known).select("_key", "_tokens", "_skeleton")
    return _extract(join_values(cells, rules, ["_skeleton"], "values", total), key)


def _extract(joined: DataFrame, key: str) -> DataFrame:
    def node(s: Column) -> Column:
        text = F.array_join(F.slice(F.col("_tokens"), s[0], s[1]), "")
        plain = F.when(text.contains("\\"), F.regexp_replace(text, "\\\\([" + _java(_SPECIAL + QUOTES) + "])", "$1")).otherwise(text)
        return F.trim(F.when(s[2] == 1, F.replace(plain, F.lit('""'), F.lit('"'))).when(s[2] == 2, F.replace(plain, F.lit("''"), F.lit("'"))).otherwise(plain))

    nodes = F.filter(F.transform("segments", node), lambda x: x != "")
    return joined.select(F.col("_key").alias(key), F.posexplode(nodes).alias("_at", "node_value")).select(
        key, (F.col("_at") + 1).cast("int").alias("node_no"), "node_value"
    )


def known_names(rules: DataFrame, nodes: str = "classpath_nodes") -> list[str]:
    """The distinct node names of the rule table, a fixed and small list."""
    return sorted(r[0] for r in rules.select(F.explode(nodes).alias("n")).filter("n is not null and trim(n) != ''").distinct().collect())
