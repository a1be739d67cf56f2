"""The main body of web pages, told from navigation, consent, related items, teasers and footers.

Page text has lost its markup, so each page is parsed back into a small tree: headings own the lines
that fit them (items below a heading for related items, prose below a teaser heading, pairs below a
specification heading), everything else hangs from the page.  A tree-structured graphical model over the
two states main / not main has a potential for each node and one for each parent-child edge; sum-product
messages upward and downward give each line's marginal.

No page comes with labels.  Patterns label some lines of a bounded sample of pages, and that is all they
do: what a line is and how main it looks is told from its words, its shape, its place on the page, its
neighbours and how many pages of the whole corpus repeat it, by two linear models trained on that sample.
Applying the model is one pass over the pages; only the counts of repeated lines are shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwright.session import cut

# Pages that the model is trained on.
TRAIN_PAGES = 1000
# A line recurs when at least this share of the pages hold it; there are at most lines per page / RECURRING of them.
RECURRING = 0.001
MIN_FEATURE = 3
SMOOTH = 0.5
STEPS, RATE, DECAY = 50, 0.5, 1e-4

# Words by which lines of the sample are labelled.
NAVIGATION = re.compile(
    r"^(?:sitename )?home$|^(?:menu|brands|contact(?: us)?|deals|track order|where to buy|about us|support|careers|my cart.*|cart.*|news|products|resources|service centers|sign in.*|log ?in|register|solutions|find a dealer|warranty registration|downloads|shop|account|my account|wish ?list|checkout|help|faq|catalog(?:ue)?|locations|store finder)$"
    r"|^toggle navigation|^skip to|^search\b.*|^select country|^back to top|^sitemap|^accessibility"
)
FOOTER = re.compile(r"©|\bcopyright\b|all rights reserved|registered (?:trade)?mark|prices shown|^call us|\bpostbox\b|\bp\.?o\.? box\b|^follow us|download our app|terms of (?:use|service)|privacy policy|do not sell|imprint")
CONSENT = re.compile(r"cookie|tracker|identifiers|consent|small files|your privacy|privacy statement|^(?:ok|allow|reject|settings|accept(?: all)?|decline|manage choices|save selection|got it|agree|necessary|statistics|marketing)$")
OFFER = re.compile(r"free (?:delivery|shipping)|9+\s?% off|first order|\bcoupon|join our list|newsletter|e-?mail address|^submit$|^subscribe|sale ends|add to cart|^buy now|gift card")
PROMPT = re.compile(r"^questions? about|chat with (?:us|an agent)|ask a question|^rate this|review(?:s)? (?:of|for)|(?:first|write a|add a|leave a) review|was this (?:page|review) helpful|^share\b|share (?:this|on)|^tweet|^print this|tell a friend|^email this|^pin it|helpful\?")
RELATED = re.compile(r"^(?:related|similar|recommended|popular|featured) (?:products|items)|also (?:viewed|bought|like|purchased)|^top sellers|^best ?sellers|recently viewed|^you may|compare similar|people who looked|frequently bought|more from|trending|goes well with|complete the")
TEASER = re.compile(r"^(?:from (?:our|the) blog|tips and guides|(?:sitename )?magazine|in the news|latest (?:news|stories)|our blog|stories|press|what'?s new|editor'?s pick.*|guides)$")
TEASER_END = re.compile(r"^(?:read more|continue reading|more stories|read the (?:full )?(?:story|article)|see all|view all|learn more|full story|show more)\b.*")
SPEC_HEAD = re.compile(r"^(?:technical (?:data|specifications?|details)|spec(?:ification)?s?|features?|key (?:benefits|features)|highlights|(?:product )?(?:description|details|overview|information)|benefits|dimensions|safety(?: (?:advice|information|notes?))?|care(?: (?:advice|instructions))?|warnings?|in the box|package contents)$")
ITEM_NO = re.compile(r"^(?:item|model|sku|mpn|part|art(?:icle)?|catalog|mfr\.? part)\.?(?: ?(?:no|number|#)\.?)?\s*[:#]?\s*[\w-]*9[\w-]*$|^(?:item|sku|model|part) ?#")
PATTERNS = {
    "teaser_end": TEASER_END, "related_head": RELATED, "teaser_head": TEASER, "spec_head": SPEC_HEAD, "item_no": ITEM_NO,
    "navigation": NAVIGATION, "consent": CONSENT, "prompt": PROMPT, "offer": OFFER, "footer": FOOTER,
}
MAIN, OTHER = 1, 0
# What a line can be; the last is none of the others, of which the shape then tells more.
ROLES = ["teaser_end", "related_head", "teaser_head", "spec_head", "item_no", "boiler", "plain"]
_BOILER = ("navigation", "consent", "prompt", "offer", "footer")

_CHAIN = re.compile(r" (?:>|»|›) |^\S+(?: \S+)? / .* / | :: ")
_BULLET = re.compile(r"^[-*•·–]\s+\S")
_PAIR = re.compile(r"^[a-z][\w ./()-]*?(?::\s+|\t+| \| | - )\S.*[^.]$")
_PROSE = re.compile(r"[.!?][\"')]?$")
_PARTS = re.compile(r"\s+[|·/]\s+|\s{2,}")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*|[$%©★]")
_ITEM = re.compile(r"9|½|¼|¾")


def mask(line: str, site: str) -> str:
    """The line in lower case with numbers as 9 and the site's name as ``sitename``."""
    low = line.strip().lower()
    if site:
        low = low.replace(site, "sitename")
    return re.sub(r"\d+", "9", low)


def masked_lines(text: Column, url: Column) -> Column:
    """The lines of a page as ``mask`` gives them."""
    name = site_name(url)
    plain = F.when(name == "", F.lower(text)).otherwise(F.replace(F.lower(text), name, F.lit("sitename")))
    return F.transform(F.split(F.regexp_replace(plain, r"\d+", "9"), "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def site_name(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z]+://(?:www\.)?([^/:.]+)", 1), F.lit(""))


def shape_of(text: str) -> str:
    """The form of a masked line, by its signs alone."""
    if not text:
        return "blank"
    if _CHAIN.search(text):
        return "chain"
    if "$" in text or "★" in text or text.endswith("(9.9)"):
        return "priced"
    if _BULLET.match(text):
        return "bullet"
    if len(_PARTS.split(text)) >= 3:
        return "menu"
    if _PROSE.search(text):
        return "prose"
    return "pair" if _PAIR.match(text) else "short"


def pattern_of(text: str, share: float) -> str | None:
    """The first pattern that a masked line meets; a line on many pages that names the site is a footer."""
    for name, rx in PATTERNS.items():
        if rx.search(text) and not (name == "related_head" and text.endswith(".")):
            return name
    return "footer" if share > 0 and "sitename" in text else None


def words_of(text: str) -> list[str]:
    """The distinct words of a masked line and its first and last."""
    w = _WORD.findall(text)
    return [*(f"w:{x}" for x in dict.fromkeys(w)), f"a:{w[0]}", f"z:{w[-1]}", f"a2:{' '.join(w[:2])}", f"z2:{' '.join(w[-2:])}"] if w else []


def line_features(text: str, shape: str, share: float) -> list[str]:
    """What is told from a line itself: words, shape, length, how many pages of the corpus repeat it."""
    level = 0 if share <= 0 else 1 + int(math.log10(share / RECURRING) * 2)
    return [*words_of(text), f"s:{shape}", f"r:{level}|{shape}", f"n:{min(8, len(text.split()))}|{shape}|{'9' in text}"]


class Linear:
    """A multinomial logistic model over sparse named features, fitted by plain gradient steps (Adagrad)."""

    def __init__(self, ids: dict[str, int], weights: np.ndarray):
        self.ids, self.weights = ids, weights

    @classmethod
    def fit(cls, rows: list[list[str]], labels: list[int], counts: list[int], classes: int) -> Linear:
        seen: Counter = Counter()
        for fs, c in zip(rows, counts):
            for f in fs:
                seen[f] += c
        ids = {f: i for i, f in enumerate(f for f, n in seen.items() if n >= MIN_FEATURE)}
        w = np.zeros((len(ids) + 1, classes))
        if not rows:
            return cls(ids, w)
        flat, of = [], []
        for i, fs in enumerate(rows):
            own = [ids[f] for f in fs if f in ids] + [len(ids)]
            flat += own
            of += [i] * len(own)
        flat_, of_ = np.array(flat), np.array(of)
        weight = np.array(counts, dtype=float)
        wanted = np.zeros((len(rows), classes))
        wanted[np.arange(len(rows)), labels] = 1.0
        square = np.full_like(w, 1e-8)
        for _ in range(STEPS):
            z = np.stack([np.bincount(of_, weights=w[flat_, c], minlength=len(rows)) for c in range(classes)], axis=1)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            off = (p - wanted) * weight[:, None] / weight.sum()
            g = np.stack([np.bincount(flat_, weights=off[of_, c], minlength=len(w)) for c in range(classes)], axis=1) + DECAY * w / len(w)
            square += g * g
            w -= RATE * g / np.sqrt(square)
        return cls(ids, w)


def seed_label(role: str, shape: str, parent: str) -> int | None:
    """The label that a line of the sample gets; None where patterns and form leave it open."""
    if role in ("boiler", "teaser_end", "related_head", "teaser_head"):
        return OTHER
    if role in ("spec_head", "item_no"):
        return MAIN
    if shape in ("chain", "menu", "priced"):
        return OTHER
    if parent == "related_head":
        return OTHER if shape == "short" else None
    if parent == "teaser_head":
        return OTHER if shape == "prose" else None
    return MAIN if shape in ("pair", "bullet", "prose") else None


def parse(masked: list[str], title: str, told_of: list[tuple | None]) -> list[dict]:
    """The nodes of a page in order: number, text, role, shape, parent (index or -1), place of item-like lines.

    ``told_of`` gives role and shape of each masked line.  A block may be interrupted by others, so a
    heading stays open until main content closes it.
    """
    nodes: list[dict] = []
    related = teaser = spec = -1
    told = 0  # lines that the open teaser has
    last_item = -1
    titled_at = -1
    for no, text in enumerate(masked, 1):
        if not text:
            continue
        kind, shape = told_of[no - 1][:2]
        here, parent = len(nodes), -1
        itemlike = shape in ("short", "priced", "pair") and kind == "plain" and _ITEM.search(text) is not None
        titled = shape in ("short", "pair") and len(title) > 3 and text == title
        if kind == "related_head":
            related, spec = here, -1
        elif kind == "teaser_head":
            teaser, told, spec = here, 0, -1
        elif kind == "spec_head":
            spec, related, teaser = here, -1, -1
        elif kind == "teaser_end":
            parent, teaser = teaser, -1
        elif kind == "boiler" or shape in ("chain", "menu"):
            pass
        elif shape == "prose" and teaser >= 0 and told == 0:
            parent, told = teaser, 1
        elif (shape in ("prose", "bullet", "pair") or kind == "item_no") and not titled:
            if (shape == "prose" or kind == "item_no") and related >= 0 and titled_at < 0 and last_item == here - 1 >= 0 and nodes[last_item]["shape"] == "short" and nodes[last_item]["parent"] == related:
                nodes[last_item]["parent"] = -1  # the line right before the body of a page without another title
                titled_at = last_item
            related = teaser = -1
            if shape == "prose" or kind == "item_no":
                spec = -1
            parent = spec
        elif titled and titled_at < 0:
            titled_at, related, teaser, spec = here, -1, -1, -1
        elif itemlike and related >= 0:
            parent = related
        elif shape == "short" and spec >= 0:
            parent = spec
        elif shape == "short" and itemlike and titled_at < 0:
            titled_at = here
        if itemlike:
            last_item = here
        nodes.append({"no": no, "text": text, "role": kind, "shape": shape, "parent": parent, "itemlike": itemlike})
    for i, node in enumerate(nodes):
        node["place"] = "title" if i == titled_at else "before" if i < titled_at or titled_at < 0 else "after"
    return nodes


def above(nodes: list[dict], i: int) -> str:
    return nodes[nodes[i]["parent"]]["role"] if nodes[i]["parent"] >= 0 else "page"


def place_key(nodes: list[dict], i: int) -> tuple:
    """Where a line stands: order from both ends, neighbours, heading, place of item-like lines."""
    node, n = nodes[i], len(nodes)
    shape = node["shape"]
    item = (node["place"], node["itemlike"]) if shape in ("short", "priced") else None
    return shape, min(i, 12), min(n - 1 - i, 12), nodes[i - 1]["shape"] if i else "^", nodes[i + 1]["shape"] if i + 1 < n else "$", above(nodes, i), item


def place_features(shape: str, top: int, end: int, before: str, after: str, up: str, item: tuple | None) -> list[str]:
    out = [f"top:{top}|{shape}", f"end:{end}|{shape}", f"prev:{before}|{shape}", f"next:{after}|{shape}", f"up:{up}|{shape}"]
    return out if item is None else [*out, f"item:{item[0]}|{item[1]}|{up}"]


def labelled(nodes: list[dict], i: int) -> int | None:
    node, up = nodes[i], above(nodes, i)
    label = seed_label(node["role"], node["shape"], up)
    if label is None and node["shape"] == "short" and up != "related_head":
        return MAIN if node["place"] == "title" or up == "spec_head" else None
    return label


class Model:
    """Roles and potentials: what each line is, how main it looks, and how a heading's state bears on its lines."""

    def __init__(self, shares: dict[int, float], roles: Linear, unary: Linear, edge: dict[str, float]):
        self.shares, self.roles, self.unary, self.edge = shares, roles, unary, edge
        lean = unary.weights[:, MAIN] - unary.weights[:, OTHER]
        # one table for both models: a feature's weights for every role and its lean to main
        self.ids = {f: i for i, f in enumerate({**roles.ids, **unary.ids})}
        self.table = np.zeros((len(self.ids) + 1, len(ROLES) + 1))
        for f, i in self.ids.items():
            if f in roles.ids:
                self.table[i, :-1] = roles.weights[roles.ids[f]]
            if f in unary.ids:
                self.table[i, -1] = lean[unary.ids[f]]
        self.table[-1, :-1], self.table[-1, -1] = roles.weights[-1], lean[-1]
        self.cache: dict[str, tuple] = {}
        self.places: dict[tuple, float] = {}

    def line(self, text: str, hashed: int) -> tuple[str, str, float]:
        """Role, shape and the score of a masked line by itself; lines recur, so they are kept."""
        got = self.cache.get(text)
        if got is None:
            shape = shape_of(text)
            rows = [i for i in map(self.ids.get, line_features(text, shape, self.shares.get(hashed, 0.0))) if i is not None]
            scores = (self.table[rows].sum(axis=0) + self.table[-1]).tolist()
            lean = scores.pop()
            got = (ROLES[scores.index(max(scores))], shape, lean)
            if len(self.cache) >= 200_000:
                self.cache.clear()
            self.cache[text] = got
        return got

    def nodes(self, masked: list[str], hashes: list[int], title: str) -> list[dict]:
        """The page's nodes with ``score``, the log potential of main against other."""
        told = [self.line(t, h) if t else None for t, h in zip(masked, hashes)]
        nodes = parse(masked, title, told)
        for i, node in enumerate(nodes):
            key = place_key(nodes, i)
            at = self.places.get(key)
            if at is None:
                rows = [k for k in map(self.ids.get, place_features(*key)) if k is not None]
                at = self.places[key] = float(self.table[rows, -1].sum())
            node["score"] = told[node["no"] - 1][2] + at
        return nodes


def marginals(nodes: list[dict], edges: dict[str, float]) -> list[float]:
    """P(main) of each node by sum-product: messages from the leaves to the root, then back.

    A node without parent and children has its own potential as marginal.
    """
    own = []
    for node in nodes:
        score = max(-30.0, min(30.0, node["score"]))
        own.append((1.0 / (1.0 + math.exp(score)), 1.0 / (1.0 + math.exp(-score))))
    below = [i for i, node in enumerate(nodes) if node["parent"] >= 0]
    if not below:
        return [o[1] for o in own]

    def edge(parent: int, p: int, s: int) -> float:
        return edges.get(f"{nodes[parent]['role']}|{p}|{s}", 0.5)

    up = {nodes[i]["parent"]: [1.0, 1.0] for i in below}  # product of the messages of a node's children
    sent: dict[int, list[float]] = {}
    for i in reversed(below):  # children follow their parents
        p, mine = nodes[i]["parent"], up.get(i, (1.0, 1.0))
        msg = [sum(edge(p, a, b) * own[i][b] * mine[b] for b in (0, 1)) for a in (0, 1)]
        z = sum(msg) or 1.0
        sent[i] = [m / z for m in msg]
        up[p] = [up[p][a] * max(sent[i][a], 1e-12) for a in (0, 1)]
        z = sum(up[p]) or 1.0
        up[p] = [u / z for u in up[p]]
    down: dict[int, list[float]] = {}
    for i in below:
        p = nodes[i]["parent"]
        rest = [own[p][a] * down.get(p, (1.0, 1.0))[a] * up[p][a] / max(sent[i][a], 1e-12) for a in (0, 1)]
        msg = [sum(edge(p, a, b) * rest[a] for a in (0, 1)) for b in (0, 1)]
        z = sum(msg) or 1.0
        down[i] = [m / z for m in msg]
    out = []
    for i, o in enumerate(own):
        u, d = up.get(i, (1.0, 1.0)), down.get(i, (1.0, 1.0))
        belief = [o[a] * u[a] * d[a] for a in (0, 1)]
        out.append(belief[1] / (sum(belief) or 1.0))
    return out


def title_of(title: str | None, site: str) -> str:
    return mask(re.split(r"\s+[|:]\s+|\s+-\s+(?=[^-]*$)", title or "")[0], site)


def train(pages: list[tuple[list[str], list[int], str]], shares: dict[int, float], hidden: frozenset[str] = frozenset()) -> Model:
    """The model from sample pages (masked lines, their hashes, title) and the shares of recurring lines.

    Roles are learned from the lines that patterns label, then the trees are built with the learned
    roles, and potentials of nodes and edges are learned from the lines that have a label.  The lines in
    ``hidden`` are kept from training, for tests.
    """
    counts: Counter = Counter((x, h) for masked, hashes, _ in pages for x, h in zip(masked, hashes) if x)
    rows, labels, n = [], [], []
    for (text, h), c in counts.items():
        shape = shape_of(text)
        if text in hidden:
            continue
        found = pattern_of(text, shares.get(h, 0.0))
        role = "boiler" if found in _BOILER else found or "plain"
        rows.append(line_features(text, shape, shares.get(h, 0.0)))
        labels.append(ROLES.index(role))
        n.append(c)
    model = Model(shares, Linear.fit(rows, labels, [1 + int(math.log2(c)) for c in n], len(ROLES)), Linear({}, np.zeros((1, 2))), {})
    rows, labels = [], []
    edges: dict[str, Counter] = defaultdict(Counter)
    for masked, hashes, title in pages:
        nodes = model.nodes(masked, hashes, title)
        told = [None if x["text"] in hidden else labelled(nodes, i) for i, x in enumerate(nodes)]
        for i, node in enumerate(nodes):
            if told[i] is None:
                continue
            rows.append(line_features(node["text"], node["shape"], shares.get(hashes[node["no"] - 1], 0.0)) + place_features(*place_key(nodes, i)))
            labels.append(told[i])
            if node["parent"] >= 0 and told[node["parent"]] is not None:
                edges[nodes[node["parent"]]["role"]][(told[node["parent"]], told[i])] += 1
    edge = {}
    for kind, c in edges.items():
        for p in (OTHER, MAIN):
            total = c[(p, OTHER)] + c[(p, MAIN)] + 2 * SMOOTH
            for s in (OTHER, MAIN):
                edge[f"{kind}|{p}|{s}"] = (c[(p, s)] + SMOOTH) / total
    return Model(shares, model.roles, Linear.fit(rows, labels, [1] * len(rows), 2), edge)


def read_pages(df: DataFrame, text: str, url: str, title: str, *keep: Column) -> DataFrame:
    """``_masked`` lines of each page that is not empty, ``_hashes`` of them, ``_site`` and ``_title``."""
    rows = df.filter(F.length(text) > 0).select(*keep, masked_lines(F.col(text), F.col(url)).alias("_masked"), site_name(F.col(url)).alias("_site"), F.col(title).alias("_title"))
    return rows.withColumn("_hashes", F.transform("_masked", lambda x: F.xxhash64(x)))


def recurring_lines(df: DataFrame, text: str, url: str, title: str) -> dict[int, float]:
    """The masked lines that at least RECURRING of all pages hold, by hash, with their share; counted over the whole corpus.

    Only hashes and counts are shuffled.
    """
    pages = read_pages(df, text, url, title)
    often = cut(pages.select(F.explode(F.array_distinct("_hashes")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3"))
    total = df.filter(F.length(text) > 0).count()
    return {r["h"]: r["n"] / total for r in often.filter(F.col("n") >= total * RECURRING).collect()}


def fit(df: DataFrame, key: str, text: str, url: str, title: str, pages: int = TRAIN_PAGES, hidden: frozenset[str] = frozenset()) -> Model:
    """The model trained on at most ``pages`` pages, chosen by a hash of their key, and on the line counts of all pages."""
    order = df.orderBy(F.xxhash64(key), key).filter(F.length(text) > 0).limit(pages)
    sample = read_pages(order, text, url, title).collect()
    return train([(r["_masked"], r["_hashes"], title_of(r["_title"], r["_site"])) for r in sample], recurring_lines(df, text, url, title), hidden)


def main_lines(df: DataFrame, key: str, text: str, url: str, title: str, model: Model | None = None) -> DataFrame:
    """One row per line with its marginal: key, ``line_no`` (from 1, blank lines counted), ``p_main``.

    Blank lines give no row, null and empty pages none, an empty table an empty result.  Repeated pages
    come out each under its key; pages of any length are read whole.
    """
    model = model or fit(df, key, text, url, title)
    handle = df.sparkSession.sparkContext.broadcast((model.shares, model.roles.ids, model.roles.weights, model.unary.ids, model.unary.weights, model.edge))

    def run(batches):
        shares, role_ids, role_w, unary_ids, unary_w, edge = handle.value
        m = Model(shares, Linear(role_ids, role_w), Linear(unary_ids, unary_w), edge)
        for pdf in batches:
            keys, nos, ps = [], [], []
            for k, masked, hashes, site, t in zip(pdf["_key"], pdf["_masked"], pdf["_hashes"], pdf["_site"], pdf["_title"]):
                nodes = m.nodes(masked.tolist(), hashes.tolist(), title_of(t, site))
                for node, p in zip(nodes, marginals(nodes, m.edge)):
                    keys.append(k), nos.append(node["no"]), ps.append(p)
            yield pd.DataFrame({"_key": pd.Series(keys, dtype="int64"), "line_no": pd.Series(nos, dtype="int32"), "p_main": pd.Series(ps, dtype="float64")})

    rows = read_pages(df, text, url, title, F.col(key).cast("bigint").alias("_key"))
    return rows.mapInPandas(run, "_key bigint, line_no int, p_main double").withColumnRenamed("_key", key)
