"""Documents packed into containers of fixed token capacity along a space-filling curve.

Each document's words are hashed into a vector, which is projected to three dimensions and mapped to a
Hilbert key, so that documents of like content lie close on the curve.  The documents are range-sorted
by that key; each range is packed on its own, in curve order, keeping a window of open containers and
giving every document the open one it fills best.  A document is split only if it is longer than the
capacity.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partwright.session import cut

DIMENSIONS, BITS = 3, 10
# Containers that stay open along the curve while documents pass by.
OPEN = 48
# Documents a range should hold: enough that what stays open at its end weighs little.
RANGE_DOCS = 20_000
_TERM = re.compile(r"[^\W\d_]{3,}")


def default_tokenizer() -> str:
    """The path of the installed public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_tokenizer(path: str):
    """A tiktoken encoding over a vocabulary file of ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of integer points, one row each, by the transposed-axes transform."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            x[0] = np.where(high, x[0] ^ p, x[0])
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= t
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def measured(docs: DataFrame, doc: str, text: str, tokenizer: str | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``curve`` (the Hilbert key) of every document with text."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        encoding = load_tokenizer(path)
        directions: dict[str, np.ndarray] = {}

        def direction(term: str) -> np.ndarray:
            got = directions.get(term)
            if got is None:
                if len(directions) > 500_000:
                    directions.clear()
                got = directions[term] = np.random.default_rng(zlib.crc32(term.encode())).standard_normal(DIMENSIONS)
            return got

        for pdf in batches:
            counts, points = [], np.zeros((len(pdf), DIMENSIONS), dtype=np.int64)
            for i, t in enumerate(pdf["text"]):
                counts.append(len(encoding.encode_ordinary(t)))
                terms = set(_TERM.findall(t.lower()))
                if terms:
                    v = np.sum([direction(w) for w in terms], axis=0)
                    v /= np.linalg.norm(v) or 1.0
                    points[i] = np.clip((v + 1) / 2 * ((1 << BITS) - 1), 0, (1 << BITS) - 1)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": pd.Series(counts, dtype="int64"), "curve": pd.Series(hilbert_keys(points) if len(pdf) else [], dtype="int64")})

    rows = docs.filter(F.length(text) > 0).select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "doc_id bigint, n_tokens bigint, curve bigint")


class Packer:
    """Best fit among a window of open containers; what leaves the window is finished."""

    def __init__(self, capacity: int, window: int = OPEN):
        self.capacity, self.window = capacity, window
        self.open: list[list] = []  # [room, pieces]
        self.done: list[tuple[int, list]] = []

    def add(self, doc: int, n_tokens: int) -> None:
        start, piece = 0, 1
        while n_tokens - start > self.capacity:
            self.done.append((0, [(doc, piece, start, self.capacity)]))
            start, piece = start + self.capacity, piece + 1
        size = n_tokens - start
        if size <= 0:
            return
        best = None
        for c in self.open:
            if size <= c[0] and (best is None or c[0] < best[0]):
                best = c
        if best is None:
            if len(self.open) >= self.window:
                fullest = min(range(len(self.open)), key=lambda i: self.open[i][0])
                self.done.append(tuple(self.open.pop(fullest)))
            best = [self.capacity, []]
            self.open.append(best)
        best[0] -= size
        best[1].append((doc, piece, start, size))
        if best[0] == 0:
            self.open.remove(best)
            self.done.append((0, best[1]))

    def close(self) -> None:
        """Repack what is still open, largest pieces first, and finish it."""
        pieces = sorted((p for _, ps in self.open for p in ps), key=lambda p: (-p[3], p[0], p[1]))
        bins: list[list] = []
        for p in pieces:
            fit = [b for b in bins if p[3] <= b[0]]
            b = min(fit, key=lambda b: b[0]) if fit else None
            if b is None:
                b = [self.capacity, []]
                bins.append(b)
            b[0] -= p[3]
            b[1].append(p)
        self.done += [(b[0], b[1]) for b in bins]
        self.open = []

    def take(self) -> list[tuple[int, list]]:
        out, self.done = self.done, []
        return out


_COLUMNS = ["pack_id", "range_no", "container_no", "order_no", "doc_id", "piece_no", "first_token", "n_tokens", "leftover"]
_SCHEMA = "pack_id int, range_no int, container_no bigint, order_no int, doc_id bigint, piece_no int, first_token bigint, n_tokens bigint, leftover bigint"


def pack(docs: DataFrame, doc: str, text: str, capacities: dict[int, int], tokenizer: str | None = None, range_docs: int = RANGE_DOCS) -> DataFrame:
    """One row per piece: ``pack_id``, ``range_no`` and ``container_no`` (the container), ``order_no`` in it,
    ``doc_id``, ``piece_no``, ``first_token``, ``n_tokens`` and the container's ``leftover`` tokens.

    Null and empty texts are put nowhere; repeated documents are packed each on their own; an empty
    table or no capacity gives an empty result; capacities below 1 are left out.  Sizes and curve keys
    are written once, as range-sorting reads them twice.  A stretch of the curve that holds very many
    documents is cut further by a hash of the id, so no range grows with a hot group.
    """
    sizes = cut(measured(docs, doc, text, tokenizer))
    wanted = {int(k): int(v) for k, v in capacities.items() if v and int(v) > 0}
    n = sizes.count()
    parts = max(1, -(-n // range_docs))
    ordered = sizes.repartitionByRange(parts, "curve", F.xxhash64("doc_id")).sortWithinPartitions("curve", "doc_id")

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packers = {k: Packer(c) for k, c in wanted.items()}
        numbers = dict.fromkeys(wanted, 0)

        def rows(k: int) -> list[tuple]:
            out = []
            for left, pieces in packers[k].take():
                numbers[k] += 1
                out += [(k, part, numbers[k], o, d, p, s, z, left) for o, (d, p, s, z) in enumerate(pieces, 1)]
            return out

        for pdf in batches:
            out = []
            for k in packers:
                for d, z in zip(pdf["doc_id"].tolist(), pdf["n_tokens"].tolist()):
                    packers[k].add(d, z)
                out += rows(k)
            yield pd.DataFrame(out, columns=_COLUMNS)
        out = []
        for k in packers:
            packers[k].close()
            out += rows(k)
        yield pd.DataFrame(out, columns=_COLUMNS)

    return ordered.mapInPandas(run, _SCHEMA)


def fill_rates(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per pack size: containers, pieces, tokens, leftover tokens and the share of capacity used."""
    boxes = packed.groupBy("pack_id", "range_no", "container_no").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"), F.first("leftover").alias("leftover"))
    per = boxes.groupBy("pack_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("pieces").alias("n_pieces"), F.sum("tokens").alias("n_tokens"), F.sum("leftover").alias("leftover"))
    return per.join(F.broadcast(capacities.select("pack_id", "capacity_tokens")), "pack_id").withColumn(
        "fill", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6)
    )
