"""Subject areas of documents, by bisecting k-means and leaf mixtures.

Terms are counted over all documents, in hashed slots, apart for each language, which its function words
tell.  The normalised vectors of all documents, folded to few dimensions, are split by bisecting k-means.
Each leaf is labelled with the subject whose telling terms its own discriminative terms match best, and
holds a mixture of subjects, from the labelled documents in it and from its label.  The words of all
leaves of a subject start its word distribution, which is sharpened on the sentences of the labelled
documents, since one sentence treats one subject.  Every document is then read whole, from its terms, which
are written once: its leaf's mixture is the prior of its sentences, each goes to the subject that explains it
best, and the document has each subject that covers at least a fifth of its words.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partwright.llm.leakage import each_text
from partwright.session import broadcast_if_small, cut

# Bound of the labelled sample: documents of a language whose sentences sharpen the word distributions.
LABELLED_DOCS = 2500
# Function words that tell a language.
FUNCTION_WORDS = {
    "en": "the and that with this from when has for are not was which before after".split(),
    "de": "der die das und ist nicht für mit auf von dem den ein eine wird bei seit sich auch zum im".split(),
    "fr": "le la les des est une pour sur dans avec du et au aux pas que nous qui cette par depuis".split(),
    "es": "el los las una para con por del que en se es y al como este desde sobre".split(),
}
CODES = list(FUNCTION_WORDS)
# Slots that terms are hashed to, dimensions that vectors are folded to, leaves, rounds of each bisection.
SLOTS, DIMS, LEAVES, SPLIT_ROUNDS = 1 << 17, 64, 64, 6
MIN_DOCS = 3
MIN_SHARE = 0.2
# From so many labelled documents on, terms must stand in documents of one subject to this share.
MIN_LABELLED, MIN_PEAK = 20, 0.45
ROUNDS = 6
# Weight of a subject's labels against its sentences' words while the distributions are sharpened.
LABEL_PRIOR = 20.0
# Discriminative terms of a leaf, the match from which it is labelled, the weight of its label in documents, and of its mixture in sentences.
TOP, MIN_MATCH, OWNER_DOCS, MIXED = 25, 0.7, 2.0, 1.0
_TERM = re.compile(r"[^\W\d_]{3,}")
# A term, or the white space that ends a sentence.
_PIECE = re.compile(r"[^\W\d_]{3,}|(?<=[.!?;])\s|\n")
# The same for ASCII text: what ends a sentence to a word of its own, then all but letters to spaces.
_END = re.compile(r"[.!?;\n](?:(?<=\n)|\s)")
_LETTERS = str.maketrans({chr(i): chr(i).lower() if chr(i).isalpha() else " " for i in range(1, 128)})
# Letters of text cut into terms at a time.
CHUNK = 4_000_000


def sentences(text: str) -> list[list[str]]:
    """The terms of each sentence, in lower case; a sentence without any term counts for nothing."""
    out, terms = [], []
    for piece in _PIECE.findall(text.lower()):
        if len(piece) > 1:
            terms.append(piece)
        elif terms:
            out.append(terms)
            terms = []
    if terms:
        out.append(terms)
    return out


def language(parsed: list[list[str]]) -> str:
    """The language whose function words occur most; English where none does."""
    seen = dict.fromkeys(FUNCTION_WORDS, 0)
    for terms in parsed:
        for t in terms:
            if t in _LANGUAGES:
                for code in _LANGUAGES[t]:
                    seen[code] += 1
    return max(seen, key=lambda c: (seen[c], c == "en"))


_LANGUAGES: dict[str, tuple[str, ...]] = {}
for _code, _list in FUNCTION_WORDS.items():
    for _w in _list:
        _LANGUAGES[_w] = (*_LANGUAGES.get(_w, ()), _code)


class Slots(dict):
    """The slot of each term, worked out once."""

    def __missing__(self, term: str) -> int:
        if len(self) > 500_000:
            self.clear()
        got = self[term] = zlib.crc32(term.encode()) % SLOTS
        return got


class Pieces(dict):
    """The number of each piece of a text, worked out once: a term's slot and, in the bits above, the languages it tells; -1 ends a sentence, -2 is a word too short for a term."""

    def __missing__(self, piece: str) -> int:
        if len(self) > 500_000:
            self.clear()
        if len(piece) < 3:
            got = -2 if piece.isalpha() else -1
        else:
            got = zlib.crc32(piece.encode()) % SLOTS + SLOTS * sum(1 << CODES.index(c) for c in _LANGUAGES.get(piece, ()))
        self[piece] = got
        return got


def pieces(text: str) -> list[str]:
    """The terms of a text in lower case, ends of sentences and, maybe, shorter words."""
    if text.isascii() and "\0" not in text:
        return _END.sub(" \0 ", text).translate(_LETTERS).split()
    return _PIECE.findall(text.lower())


class Parsed:
    """The terms of several texts, one after the other: ``slot``, the number of the text ``of`` and of the ``sentence``; ``code`` of each text's language."""

    def __init__(self, of: np.ndarray, sentence: np.ndarray, slot: np.ndarray, code: np.ndarray):
        self.n, self.of, self.sentence, self.slot, self.code = len(code), of, sentence, slot, code

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, slot and how often, by text and slot."""
        keys, n = np.unique(self.of * SLOTS + self.slot, return_counts=True)
        return keys // SLOTS, keys % SLOTS, n

    def stored(self) -> tuple[pa.Array, pa.Array]:
        """What is kept of each text: ``code`` and ``terms``, the slots, with SLOTS added where a sentence begins."""
        begins = np.diff(self.sentence, prepend=-1) > 0
        ends = np.append(0, np.cumsum(np.bincount(self.of, minlength=self.n)))
        return pa.array(self.code, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(self.slot + SLOTS * begins, pa.int32()))


def numbered(flat: np.ndarray, sizes: np.ndarray) -> Parsed:
    """Texts of pieces with numbers as Pieces gives them; ``sizes``: how many each text has."""
    ends = flat == -1
    ends[np.cumsum(sizes)[:-1][sizes[1:] > 0]] = True  # a text begins a sentence
    kept = np.flatnonzero(flat >= 0)
    of, told = np.repeat(np.arange(len(sizes)), sizes)[kept], flat[kept] // SLOTS
    seen = np.stack([np.bincount(of[told >> c & 1 > 0], minlength=len(sizes)) for c in range(len(CODES))])
    return Parsed(of, np.cumsum(ends)[kept], flat[kept] % SLOTS, seen.argmax(axis=0))  # English is the first


def parsed(texts: Iterable[str], numbers: Pieces) -> Iterator[Parsed]:
    """The terms of stretches of the texts."""
    flat, sizes, letters = [], [], 0
    for text in texts:
        found = pieces(text)
        flat += found
        sizes.append(len(found))
        letters += len(text)
        if letters >= CHUNK:
            yield numbered(np.fromiter(map(numbers.__getitem__, flat), dtype=np.int64, count=len(flat)), np.array(sizes))
            flat, sizes, letters = [], [], 0
    if sizes:
        yield numbered(np.fromiter(map(numbers.__getitem__, flat), dtype=np.int64, count=len(flat)), np.array(sizes))


def _read(batches):
    numbers = Pieces()
    for batch in batches:
        done = 0
        for part in parsed(each_text(batch.column(1)), numbers):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, part.n), *part.stored()], ["doc_id", "code", "terms"])
            done += part.n


def read_again(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, Parsed]]:
    """``doc_id`` and terms of stretches of what _read gave."""
    doc, code, terms = (batch.column(c) for c in ("doc_id", "code", "terms"))
    sizes = terms.value_lengths().to_numpy()
    stretch = np.cumsum(sizes, dtype=np.int64) // (CHUNK // 4)
    for begin, end in zip(first := np.flatnonzero(np.diff(stretch, prepend=-1)), np.append(first[1:], len(sizes))):
        flat = terms.slice(begin, end - begin).flatten().to_numpy()
        yield doc.slice(begin, end - begin), Parsed(np.repeat(np.arange(end - begin), sizes[begin:end]), np.cumsum(flat // SLOTS) - 1, flat % SLOTS, code.slice(begin, end - begin).to_numpy())


def document_terms(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``code`` and ``terms`` of every document with a text, written to the shared folder; the text is not read again."""
    texts = docs.filter(F.length("text") > 0).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return cut(texts.mapInArrow(_read, "doc_id bigint, code int, terms array<int>"))


def _document_counts(batches):
    n = np.zeros(len(CODES) * SLOTS, dtype=np.int64)
    for batch in batches:
        for _, part in read_again(batch):
            of, slots, _ = part.counts()
            n += np.bincount(part.code[of] * SLOTS + slots, minlength=len(n))
    seen = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(seen // SLOTS, pa.int32()), pa.array(seen % SLOTS, pa.int32()), pa.array(n[seen])], ["code", "slot", "df"])


@lru_cache(maxsize=1)
def _fold() -> tuple[np.ndarray, np.ndarray]:
    """The dimension and sign of each slot."""
    rng = np.random.default_rng(5)
    return rng.integers(DIMS, size=SLOTS), rng.choice(np.array([-1.0, 1.0], dtype=np.float32), size=SLOTS)


def summed(of: np.ndarray, slots: np.ndarray, counts: np.ndarray, codes: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The vectors of documents: log counts weighted by inverse document frequency, folded by signed hashing."""
    at, sign = _fold()
    w = np.log1p(counts) * idf[codes[of], slots] * sign[slots]
    return np.bincount(of * DIMS + at[slots], weights=w, minlength=len(codes) * DIMS).reshape(len(codes), DIMS)


def folded(of: np.ndarray, slots: np.ndarray, counts: np.ndarray, codes: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The normalised vectors of documents."""
    out = summed(of, slots, counts.astype(np.float32), codes, idf).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(vectors @ centres.T, axis=1) if len(centres) else np.zeros(len(vectors), dtype=np.int64)


def grown(tokens: DataFrame, idf: np.ndarray) -> np.ndarray:
    """The centres of the leaves of bisecting k-means over the vectors of all documents; a vector without length has no direction and takes no part."""
    handle = tokens.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        for batch in batches:
            for _, part in read_again(batch):
                found = folded(*part.counts(), part.code, handle.value)
                found = found[np.linalg.norm(found, axis=1) > 0.5]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * DIMS, pa.int32()), pa.array(found.ravel(), pa.float32()))], ["v"])

    vectors = cut(tokens.filter(F.size("terms") > 0).mapInArrow(run, "v array<float>")).select(array_to_vector("v").alias("features"))
    if not vectors.head(1):
        return np.zeros((0, DIMS), dtype=np.float32)
    tree = BisectingKMeans(k=LEAVES, maxIter=SPLIT_ROUNDS, seed=7, distanceMeasure="cosine").fit(vectors)
    centres = np.array(tree.clusterCenters(), dtype=np.float32)
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)


def fit(docs: DataFrame, tokens: DataFrame, labels: DataFrame, subjects: DataFrame, mixed: float = MIXED) -> dict:
    """The model: word distributions per language, leaves and their mixtures; ``tokens`` are the terms of the documents.

    Counts, vectors, leaves, discriminative terms and mixtures come from all documents; only the sentences
    that sharpen the word distributions are those of at most LABELLED_DOCS labelled documents a language.
    What reaches the driver is bounded by slots, leaves, subjects and that sample.
    """
    spark = docs.sparkSession
    names = {r["subject_id"]: f"{r['subject_name'] or ''} {r['description'] or ''}" for r in subjects.collect()}
    subject_ids = sorted(names)
    texts = docs.filter(F.length("text") > 0).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    held = tokens.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()
    n_docs = np.zeros(len(CODES))
    for r in held:
        n_docs[r["code"]] = r["n"]
    df = cut(tokens.mapInArrow(_document_counts, "code int, slot int, df bigint").groupBy("code", "slot").agg(F.sum("df").alias("df")).filter(F.col("df") >= MIN_DOCS))
    idf, seen = np.zeros((len(CODES), SLOTS), dtype=np.float32), np.zeros((len(CODES), SLOTS), dtype=np.float64)
    known = df.toPandas()
    if len(known):
        c, s = known["code"].to_numpy(), known["slot"].to_numpy()
        seen[c, s] = known["df"]
        idf[c, s] = np.log((1 + n_docs[c]) / (1 + known["df"].to_numpy()))
    centres = grown(tokens, idf)

    votes = cut(labels.filter("doc_id is not null and subject_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "subject_id").distinct())
    marked = cut(votes.groupBy("doc_id").agg(F.sort_array(F.collect_set("subject_id")).alias("s")))
    handle = spark.sparkContext.broadcast((idf, centres))

    def leafed(batches):
        weights, mid = handle.value
        for batch in batches:
            for doc, part in read_again(batch):
                leaf = nearest(folded(*part.counts(), part.code, weights), mid)
                yield pa.RecordBatch.from_arrays([doc, pa.array(part.code, pa.int32()), pa.array(leaf, pa.int32())], ["doc_id", "code", "leaf"])

    def gathered(batches):
        weights, mid = handle.value
        for batch in batches:
            for _, part in read_again(batch):
                of, slots, counts = part.counts()
                leaf = nearest(folded(of, slots, counts, part.code, weights), mid)
                keys, at, n = np.unique((part.code * np.int64(LEAVES) + leaf)[of] * SLOTS + slots, return_inverse=True, return_counts=True)
                words = np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64)
                own = keys // SLOTS
                columns = {"code": pa.array(own // LEAVES, pa.int32()), "leaf": pa.array(own % LEAVES, pa.int32()), "slots": pa.array(keys % SLOTS, pa.int32()), "n": pa.array(n), "words": pa.array(words)}
                yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    in_leaf = cut(tokens.mapInArrow(leafed, "doc_id bigint, code int, leaf int"))
    told = in_leaf.join(broadcast_if_small(marked, marked.count()), "doc_id")
    leaf_votes = told.select("code", "leaf", F.explode("s").alias("subject_id"), (1.0 / F.size("s")).alias("w")).groupBy("code", "leaf", "subject_id").agg(F.sum("w").alias("w")).collect()

    order = Window.partitionBy("code").orderBy(F.xxhash64("doc_id"), "doc_id")
    wanted = cut(told.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= LABELLED_DOCS).select("doc_id", "code", "s"))
    sample = texts.join(F.broadcast(wanted), "doc_id").collect()
    by: dict[int, list] = defaultdict(list)
    slots = Slots()
    for r in sorted(sample, key=lambda r: r["doc_id"]):
        by[r["code"]].append((frozenset(r["s"]), [[slots[t] for t in s] for s in sentences(r["text"])]))
    telling = {c: telling_terms(by.get(c, []), subject_ids, names, slots, seen[c]) for c in range(len(CODES))}

    # the discriminative terms of each leaf, and with them its label
    cells = tokens.mapInArrow(gathered, "code int, leaf int, slots int, n bigint, words bigint").groupBy("code", "leaf", "slots").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    cells = cut(cells.join(broadcast_if_small(df.withColumnRenamed("slot", "slots"), len(known)), ["code", "slots"]))
    sizes = in_leaf.groupBy("code", "leaf").agg(F.count(F.lit(1)).alias("size"))
    everywhere = F.broadcast(spark.createDataFrame([(c, float(max(n, 1))) for c, n in enumerate(n_docs)], "code int, total double"))
    share = F.col("n") / F.col("size")
    lift = F.ln((share + 1e-3) / (F.col("df") / F.col("total") + 1e-3)) * share
    best = Window.partitionBy("code", "leaf").orderBy(F.desc("lift"), "slots")
    top = cells.join(F.broadcast(sizes), ["code", "leaf"]).join(everywhere, "code").withColumn("lift", lift).withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= TOP).select("code", "leaf", "slots", "lift").collect()
    by_leaf: dict[tuple[int, int], list] = defaultdict(list)
    for r in top:
        by_leaf[(r["code"], r["leaf"])].append((r["slots"], max(r["lift"], 0.0)))
    k = len(subject_ids)
    owner = {}
    for (c, leaf), terms in by_leaf.items():
        at, w = np.array([t for t, _ in terms]), np.array([x for _, x in terms])
        match = (np.clip(telling[c][:, at], -2, 4) * w).sum(axis=1) / max(w.sum(), 1e-9) if k else np.zeros(0)
        owner[(c, leaf)] = int(match.argmax()) if k and match.max() >= MIN_MATCH else k

    # the words of all leaves of a subject start its distribution
    owners = spark.createDataFrame([(c, leaf, o) for (c, leaf), o in owner.items()], "code int, leaf int, owner int")
    words = cells.join(F.broadcast(owners), ["code", "leaf"]).groupBy("code", "owner", "slots").agg(F.sum("words").alias("words")).toPandas()
    mixtures = np.full((len(CODES), max(len(centres), 1), k + 1), 1.0)
    for (c, leaf), o in owner.items():
        mixtures[c, leaf, o] += OWNER_DOCS
    place = {s: j for j, s in enumerate(subject_ids)}
    for r in leaf_votes:
        if r["subject_id"] in place:
            mixtures[r["code"], r["leaf"], place[r["subject_id"]]] += r["w"]
    mixtures[:, :, k] = np.maximum(mixtures[:, :, k], mixtures[:, :, :k].sum(axis=2) / 4)
    mixtures = mixed * np.log(mixtures / mixtures.sum(axis=2, keepdims=True))
    parts = []
    for c in range(len(CODES)):
        own = words[words["code"] == c]
        start = np.full((SLOTS, k + 1), 0.0, dtype=np.float64)
        start[own["slots"].to_numpy(), own["owner"].to_numpy()] = own["words"]
        parts.append(sharpened(by.get(c, []), subject_ids, telling[c], start, seen[c], k))
    return {"subjects": subject_ids, "idf": idf, "centres": centres, "mixtures": mixtures.astype(np.float32), "parts": parts}


def telling_terms(sample: list, subject_ids: list[int], names: dict[int, str], slots: Slots, seen: np.ndarray) -> np.ndarray:
    """Per subject and slot the log odds of the term in documents with the label against those without; more for words of its name."""
    k = len(subject_ids)
    inside, base = np.zeros((k, SLOTS)), np.zeros(SLOTS)
    size = np.zeros(k)
    for own, parsed in sample:
        terms = np.unique([t for s in parsed for t in s]).astype(np.int64)
        base[terms] += 1
        for j, s in enumerate(subject_ids):
            if s in own:
                size[j] += 1 / len(own)
                inside[j, terms] += 1 / len(own)
    rest = np.maximum(len(sample) - size, 1e-6)
    out = np.log((inside + 0.5) / (np.maximum(size, 1e-6)[:, None] + 1)) - np.log((np.maximum(base - inside, 0) + 0.5) / (rest[:, None] + 1))
    for j, s in enumerate(subject_ids):
        for t in set(_TERM.findall(names[s].lower())):
            for form in (t, t.rstrip("s"), t + "s"):
                if seen[slots[form]] > 0:
                    out[j, slots[form]] += 1.0
    return out


def sharpened(sample: list, subject_ids: list[int], telling: np.ndarray, start: np.ndarray, seen: np.ndarray, k: int) -> dict:
    """The word distributions of a language: ``slots`` that tell subjects apart, ``logp`` per component (last: none), ``prior``."""
    known = np.flatnonzero(seen > 0)
    empty = {"slots": np.zeros(0, dtype=np.int64), "logp": np.zeros((0, k + 1), dtype=np.float32), "prior": np.zeros(k + 1, dtype=np.float32)}
    if not len(known) or not k:
        return empty
    every = start.sum(axis=1)
    for j in range(k):  # a subject without a leaf starts from its telling terms
        if not start[:, j].any():
            start[known, j] = np.exp(np.clip(telling[j, known], -3, 3)) * every[known] / max(every.sum(), 1.0) * 200
    start[:, k] += every * 0.05
    start[known] += 0.05
    kept = known
    if len(sample) >= MIN_LABELLED:
        together, base = np.zeros((SLOTS, k)), np.zeros(SLOTS)
        for own, parsed in sample:
            terms = np.unique([t for s in parsed for t in s]).astype(np.int64)
            base[terms] += 1
            for j, s in enumerate(subject_ids):
                if s in own:
                    together[terms, j] += 1
        kept = known[together[known].max(axis=1) / (base[known] + 2) >= MIN_PEAK]
    prior = np.zeros(k + 1)
    model = empty
    for _ in range(2):
        if not len(kept):
            break
        logp = np.log(start[kept] / start[kept].sum(axis=0))
        model = {"slots": kept, "logp": logp.astype(np.float32), "prior": prior.astype(np.float32)}
        flat, bounds, own, all_terms = _rows(sample, kept, subject_ids)
        if not len(flat):
            break
        of = np.repeat(np.arange(len(bounds)), np.diff(np.append(bounds, len(flat))))
        for _ in range(ROUNDS):
            score = np.add.reduceat(logp[flat], bounds, axis=0) + own + prior
            score -= score.max(axis=1, keepdims=True)
            post = np.exp(score)
            post /= post.sum(axis=1, keepdims=True)
            new = np.full((len(kept), k + 1), 0.05)
            for c in range(k + 1):
                new[:, c] += np.bincount(flat, weights=post[of, c], minlength=len(kept))
            logp = np.log(new / new.sum(axis=0))
            prior = np.log((post.sum(axis=0) + 1) / (len(bounds) + k + 1))
        model = {"slots": kept, "logp": logp.astype(np.float32), "prior": prior.astype(np.float32)}
        # the sentences told so far show which of all terms tell subjects apart
        start = np.full((SLOTS, k + 1), 0.05)
        for row, terms in enumerate(all_terms):
            start[terms] += post[row]
        kept = known[start[known].max(axis=1) / (start[known].sum(axis=1) + 2) >= MIN_PEAK]
    return model


def _rows(sample: list, kept: np.ndarray, subject_ids: list[int]):
    """Sentences with kept terms: their terms' places in ``kept``, where each begins, log label priors, and all their slots."""
    place = {int(i): j for j, i in enumerate(kept)}
    flat, bounds, prior, every = [], [], [], []
    for labels, parsed in sample:
        own = np.array([LABEL_PRIOR if s in labels else 1.0 for s in subject_ids] + [LABEL_PRIOR / 4]) if labels else np.ones(len(subject_ids) + 1)
        for terms in parsed:
            told = [place[i] for i in terms if i in place]
            if told:
                bounds.append(len(flat))
                flat.extend(told)
                prior.append(own)
                every.append(sorted(set(terms)))
    return np.array(flat, dtype=np.int64), np.array(bounds, dtype=np.int64), np.log(np.array(prior)), every


class Reader:
    """Reads documents with a model."""

    def __init__(self, model: dict):
        self.model = model
        self.places = np.full((len(CODES), SLOTS), -1, dtype=np.int32)
        for c, part in enumerate(model["parts"]):
            self.places[c, part["slots"]] = np.arange(len(part["slots"]))

    def shares(self, read: Parsed) -> np.ndarray:
        """The share of each text's words that each component covers; the last is none."""
        m = self.model
        out = np.zeros((read.n, len(m["subjects"]) + 1))
        of, slots, counts = read.counts()
        # only the direction of a vector tells which centre is nearest
        leaf = nearest(summed(of, slots, counts, read.code, m["idf"]), m["centres"])
        sizes = np.bincount(read.sentence)
        place = self.places[read.code[read.of], read.slot]
        for c, part in enumerate(m["parts"]):
            at = np.flatnonzero((place >= 0) & (read.code[read.of] == c))
            if not len(at):
                continue
            bounds = np.flatnonzero(np.diff(read.sentence[at], prepend=-1))
            text, sentence = read.of[at[bounds]], read.sentence[at[bounds]]
            best = np.argmax(np.add.reduceat(part["logp"][place[at]], bounds, axis=0) + part["prior"] + m["mixtures"][c, leaf[text]], axis=1)
            np.add.at(out, (text, best), sizes[sentence])
        return out / np.maximum(np.bincount(read.of, minlength=read.n), 1)[:, None]


def subject_shares(tokens: DataFrame, model: dict) -> DataFrame:
    """``doc_id``, ``subject_id``, ``share`` of every document and subject with a share above 0."""
    handle = tokens.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        reader = Reader(handle.value)
        subject_ids = pa.array(reader.model["subjects"], pa.int32())
        for batch in batches:
            for doc, part in read_again(batch):
                share = reader.shares(part)[:, :-1]
                at, j = np.nonzero(share > 0)
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(at)), subject_ids.take(pa.array(j)), pa.array(share[at, j])], ["doc_id", "subject_id", "share"])

    return tokens.mapInArrow(run, "doc_id bigint, subject_id int, share double")


def document_subjects(docs: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """One row per document and subject that covers at least MIN_SHARE of its words.

    Null and empty texts and texts without any subject have no row; repeated documents come out each
    under its id; without documents, labels or subjects the result is empty or rests on names and
    descriptions alone; extra columns are ignored.
    """
    tokens = document_terms(docs)
    return subject_shares(tokens, fit(docs, tokens, labels, subjects)).filter(F.col("share") >= MIN_SHARE).select("doc_id", "subject_id")
