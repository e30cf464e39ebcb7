"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear SVM.

The kernel of two strings counts their common gapped subsequences of three
characters, each weighted by GAP per character it spans, inside a bounded span; it
is normalised. An insult with inserted, separated or repeated characters keeps most
of its subsequences, so it stays near the plain one.

Labels come per document. A sentence of a toxic document is positive through its
best word group only (multiple-instance learning: start from the units that toxic
documents have over others, then train and choose again). A second, small machine
weighs a document's best units, since one near miss is no insult. The first is trained on
Nyström features K(x, Z) K(Z, Z)^-1/2. As the features are linear in the kernel, the
decision value of a unit is a sum of weights over its subsequences, which scores
whole corpora without comparing units to landmarks one by one.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import tokens

GAP = 0.6
SPAN = 7  # characters that a subsequence may span
LETTERS = 28  # blank, a-z, any other
LONGEST = 48  # longer units are scored in overlapping windows of this length
MAX_TRAIN = 4_000  # labelled documents in the training sample, at most
LANDMARKS = 96
BEST = 4  # units of a document that decide it
_AT_ONCE = 1 << 17  # subsequences that are weighed at a time


@cache
def _positions(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples of a string and their weights."""
    out = [(i, j, k) for i in range(length) for j in range(i + 1, length) for k in range(j + 1, min(length, i + SPAN))]
    at = np.array(out, np.int64).reshape(-1, 3)
    return at, (GAP ** (at[:, 2] - at[:, 0] - 2)).astype(np.float64)


def _letter_table() -> np.ndarray:
    table = np.full(0x250, LETTERS - 1, np.int64)
    for c in range(0x250):
        base = unicodedata.normalize("NFKD", chr(c))[:1].lower()
        if "a" <= base <= "z":
            table[c] = ord(base) - 96
    for c, base in zip("013457@$!|", "oieasTasii".lower()):  # digits and signs that stand for letters
        table[ord(c)] = ord(base) - 96
    return table


_TABLE = _letter_table()


def _codes(units: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Unit numbers and letter codes, by length (3 to LONGEST); windows of longer ones."""
    by: dict[int, tuple[list[int], list[str]]] = defaultdict(lambda: ([], []))
    for i, u in enumerate(units):
        for a in range(0, max(1, len(u) - SPAN), LONGEST - SPAN):
            part = u[a : a + LONGEST]
            if len(part) >= 3:
                by[len(part)][0].append(i)
                by[len(part)][1].append(part)
    out = {}
    for n, (at, parts) in by.items():
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
        out[n] = np.array(at), np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)], LETTERS - 1)
    return out


def _subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subsequence numbers, weights and norms of units of one length."""
    at, weight = _positions(codes.shape[1])
    seq = (codes[:, at[:, 0]] * LETTERS + codes[:, at[:, 1]]) * LETTERS + codes[:, at[:, 2]]
    order = np.argsort(seq, axis=1)
    ranked = np.take_along_axis(seq, order, 1)
    w = weight[order]
    # equal subsequences of a unit add up before they are squared
    total = np.cumsum(w, axis=1)
    last = np.ones(ranked.shape, bool)
    last[:, :-1] = ranked[:, 1:] != ranked[:, :-1]
    ends = np.where(last, total, 0.0)
    before = np.zeros_like(ends)
    before[:, 1:] = np.maximum.accumulate(ends, axis=1)[:, :-1]
    norm = np.sqrt(np.where(last, (total - before) ** 2, 0).sum(axis=1))
    return seq, np.broadcast_to(weight, seq.shape), norm


def features(units: list[str]) -> np.ndarray:
    """Normalised subsequence vectors (dense; for landmarks and training units)."""
    out = np.zeros((len(units), LETTERS**3), np.float32)
    for at, codes in _codes(units).values():
        seq, w, norm = _subsequences(codes)
        np.add.at(out, (at[:, None], seq), w / np.maximum(norm, 1e-12)[:, None])
    return out


@dataclass
class Model:
    weights: np.ndarray  # of subsequences
    bias: float
    top: np.ndarray  # weights of a document's best units, and a constant

    def units(self, units: list[str]) -> np.ndarray:
        """Decision values; of a long unit the largest over its windows."""
        out = np.full(len(units), self.bias)
        best = np.full(len(units), -np.inf)
        for at, codes in _codes(units).values():
            some = max(1, _AT_ONCE // len(_positions(codes.shape[1])[0]))
            for a in range(0, len(codes), some):
                seq, w, norm = _subsequences(codes[a : a + some])
                value = (self.weights[seq] * w).sum(axis=1) / np.maximum(norm, 1e-12) + self.bias
                np.maximum.at(best, at[a : a + some], value)
        return np.where(np.isfinite(best), best, out)

    def probability(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(top_values(self, *units_of(texts)) @ self.top[:-1] + self.top[-1], -40, 40)))


def units_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(unit codes, offsets of each text, distinct units).

    Units are the words, lower-cased and without anything but letters, digits and the
    signs that stand for letters; a run of three or more single characters (a word
    spelt out) is one unit more.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))
    split = pc.utf8_split_whitespace(low)
    offsets = split.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = split.flatten().dictionary_encode()
    clean = pc.replace_substring_regex(coded.dictionary, r"^[^\pL\pN@$]+|[^\pL\pN]+$|[^\pL\pN@$!|]+", "").dictionary_encode()
    code = clean.indices.to_numpy().astype(np.int64)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    known = clean.dictionary.to_pylist()
    single = np.array([len(u) == 1 for u in known], bool)[code] if len(code) else np.zeros(0, bool)
    if not single.any():
        return code, offsets, known
    edge = np.diff(np.concatenate([[0], single.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    extra_at, extra = [], []
    index = {u: i for i, u in enumerate(known)}
    long = ends - starts >= 3
    for a, b in zip(starts[long].tolist(), ends[long].tolist()):
        doc = int(np.searchsorted(offsets, a, "right")) - 1
        while a < b:  # a run may go on into the next text
            stop = min(b, int(offsets[doc + 1]))
            if stop - a >= 3:
                u = "".join(known[c] for c in code[a:stop])
                extra.append(index.setdefault(u, len(index)))
                extra_at.append(stop)
            a, doc = stop, doc + 1
    if extra:
        added = np.bincount(np.searchsorted(offsets, np.array(extra_at), "left") - 1, minlength=len(offsets) - 1) if len(offsets) > 1 else np.zeros(0, np.int64)
        code = np.insert(code, extra_at, extra)
        offsets = offsets + np.append(0, np.cumsum(added))
        known = list(index)
    return code, offsets, known


def _gram_evidence(units: list[str], pos: np.ndarray, neg: np.ndarray, share: float, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Per unit the strongest evidence of its runs of four or five letters, and that
    run's number: insults that come in many forms are rare one by one. A run counts
    where it is ``ratio`` times as frequent in toxic documents as in others."""
    best, which = np.full(len(units), -np.inf), np.full(len(units), -1)
    grams = []
    for at, codes in _codes(units).values():
        for n in (4, 5):
            if codes.shape[1] >= n:
                g = np.zeros((len(codes), codes.shape[1] - n + 1), np.int64)
                for k in range(n):
                    g = g * LETTERS + codes[:, k : k + g.shape[1]]
                grams.append((at, ((g * 2 + n % 2) % 4_194_301).astype(np.int32)))
    # counts of the runs that occur: a table of all numbers would fill the driver
    met = np.zeros(4_194_301, bool)
    for _, g in grams:
        met[g] = True
    used = np.flatnonzero(met).astype(np.int32)
    del met
    p, q = np.zeros(len(used), np.float32), np.zeros(len(used), np.float32)
    for at, g in grams:
        wide, place = g.shape[1], np.searchsorted(used, g).ravel()
        p += np.bincount(place, np.repeat(pos[at], wide), len(p)).astype(np.float32)
        q += np.bincount(place, np.repeat(neg[at], wide), len(q)).astype(np.float32)
    z = (p - share * (p + q)) / np.sqrt(share * (1 - share) * np.maximum(p + q, 1))
    z[(p + 0.5) * (1 - share) < ratio * (q + 0.5) * share] = -np.inf
    for at, g in grams:
        own = z[np.searchsorted(used, g)]
        top = own.argmax(axis=1)
        value = own[np.arange(len(g)), top]
        better = value > best[at]
        best[at[better]] = value[better]
        which[at[better]] = g[better, top[better]]
    return best, which


def _fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Linear SVM with squared hinge loss, by accelerated gradient descent."""
    ridge = 1e-4
    w = np.zeros(x.shape[1])
    v, step = w.copy(), 1.0 / (2 * np.linalg.norm(x * np.sqrt(weight)[:, None], 2) ** 2 + ridge)
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        grad = ridge * v - 2 * x.T @ (weight * y * slack)
        new = v - step * grad
        v = new + t / (t + 3) * (new - w)
        w = new
    return w


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Fits both machines on labelled documents; texts and labels alone are inputs.

    The machine of units learns from two thirds of either class and the machine of
    documents from the last third, where units are as new as they will be later.
    """
    place = {0: 0, 1: 0}
    last = []
    for y in labels:
        last.append(place[int(bool(y))] % 3 == 2)
        place[int(bool(y))] += 1
    if min(place.values()) < 30:
        first, last = [True] * len(texts), [True] * len(texts)
    else:
        first = [not x for x in last]
    model = _train_units([t for t, x in zip(texts, first) if x], [y for y, x in zip(labels, first) if x], seed)
    y_doc = np.array([bool(y) for y, x in zip(labels, last) if x], bool)
    if not model.weights.any() or not y_doc.any() or y_doc.all():
        return model
    # The machine of documents: their best units, counted with repeats.
    x = top_values(model, *units_of(pa.array([t for t, k in zip(texts, last) if k], pa.string())))
    z = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(BEST + 1), np.diag([1e-4] * BEST + [1e-8])
    for _ in range(60):  # Newton steps of a ridge-penalised logistic regression
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p) / len(z))[:, None]).T @ z + ridge, z.T @ (y_doc - p) / len(z) - ridge @ w)
    model.top = w
    return model


def _train_units(texts: list[str], labels: list[int], seed: int) -> Model:
    """The machine of units; its Model weighs no documents yet."""
    y_doc = np.array(labels, bool)
    code, offsets, known = units_of(pa.array(texts, pa.string()))
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    if not y_doc.any() or y_doc.all() or not len(code):
        share = float(y_doc.mean()) if len(y_doc) else 0.0
        return Model(np.zeros(LETTERS**3), 0.0, np.append(np.zeros(BEST), np.log((share + 1e-3) / (1 - share + 1e-3))))
    pairs = np.unique(doc * len(known) + code)
    in_doc, unit = pairs // len(known), pairs % len(known)
    pos = np.bincount(unit[y_doc[in_doc]], minlength=len(known)).astype(float)
    neg = np.bincount(unit[~y_doc[in_doc]], minlength=len(known)).astype(float)
    size = np.array([len(u) for u in known])
    odds = np.log((pos + 0.5) / (y_doc.sum() + 1)) - np.log((neg + 0.5) / ((~y_doc).sum() + 1))
    # evidence: how far the toxic count exceeds its share, in standard deviations
    share = y_doc.mean()
    seen = pos + neg
    excess = (pos - share * seen) / np.sqrt(share * (1 - share) * np.maximum(seen, 1))
    # the strictest evidence that reaches nearly all toxic documents
    for ratio in (50, 15, 5):
        gram, which = _gram_evidence(known, pos, neg, share, ratio)
        proof = np.maximum(np.where(odds > np.log(ratio), excess, -np.inf), gram)
        good = np.flatnonzero((size >= 4) & (pos > 0) & (proof > 6))
        reached = np.unique(in_doc[np.isin(unit, good) & y_doc[in_doc]])
        if len(reached) >= 0.97 * y_doc.sum():
            break
    excess = proof
    rng = np.random.default_rng(seed)
    top, forms = [], Counter()
    for i in good[np.lexsort((-pos[good], -excess[good]))].tolist():
        forms[int(which[i])] += 1
        if forms[int(which[i])] <= 3:  # a few forms of one insult suffice
            top.append(i)
        if len(top) == LANDMARKS // 2:
            break
    if not top:
        some = np.flatnonzero((size >= 3) & (pos > neg))
        top = some[np.argsort(-(pos - neg)[some], kind="stable")][:8].tolist()
    top = np.array(top, np.int64)
    seeds = good if len(good) else top
    seeds = seeds[np.argsort(-excess[seeds], kind="stable")][:1500]
    taken = np.zeros(len(known), bool)
    taken[seeds] = True
    common = np.flatnonzero((size >= 3) & (neg > 0) & ~taken)
    common = common[np.argsort(-neg[common], kind="stable")]
    rest = rng.permutation(common[: 40 * LANDMARKS])[: LANDMARKS - len(top)]
    phi = features([known[i] for i in [*top, *rest]]).astype(np.float64)
    gram = phi @ phi.T
    value, vector = np.linalg.eigh(gram)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-4))) @ vector.T
    back = phi.T @ root  # subsequence space -> Nyström features
    del phi

    def nystrom(units: np.ndarray) -> np.ndarray:
        return np.concatenate([features([known[i] for i in units[a : a + 128]]) @ back for a in range(0, len(units), 128)] or [np.zeros((0, len(root)))])

    negatives = np.unique(np.concatenate([common[:1500], rng.permutation(common)[:2500]]))
    chosen = Counter({int(i): int(max(pos[i], 1)) for i in seeds})
    by_doc = [unit[a:b] for a, b in zip(np.searchsorted(in_doc, np.flatnonzero(y_doc)), np.searchsorted(in_doc, np.flatnonzero(y_doc), "right"))]
    clean_units = common
    model = Model(np.zeros(LETTERS**3), 0.0, np.zeros(BEST + 1))
    for turn in range(3):
        units = np.concatenate([np.fromiter(chosen, np.int64), negatives])
        y = np.concatenate([np.ones(len(chosen)), -np.ones(len(negatives))])
        weight = np.concatenate([np.fromiter(chosen.values(), float) / max(sum(chosen.values()), 1), np.full(len(negatives), 1.0 / max(len(negatives), 1))])
        x = np.hstack([nystrom(units), np.ones((len(units), 1))])
        w = _fit_svm(x, y, weight)
        model = Model(back @ w[:-1], float(w[-1]), np.zeros(BEST + 1))
        if turn == 2:
            break
        # choose again: hard negatives, and the best unit of each toxic document
        value = np.full(len(known), -np.inf)
        some = np.unique(np.concatenate([clean_units[:60_000], *by_doc])) if by_doc else clean_units[:60_000]
        value[some] = model.units([known[i] for i in some])
        hard = clean_units[np.argsort(-value[clean_units], kind="stable")][:1500]
        negatives = np.unique(np.concatenate([negatives, hard]))
        chosen = Counter({int(i): int(max(pos[i], 1)) for i in seeds})
        for own in by_doc:
            fit = own[(neg[own] == 0) & (size[own] >= 3)]
            if len(fit) and value[fit].max() > 0:
                chosen[int(fit[np.argmax(value[fit])])] += 1
    return model


def top_values(model: Model, code: np.ndarray, offsets: np.ndarray, known: list[str]) -> np.ndarray:
    """Per text the BEST largest decision values of its units, largest first, cut to
    0..1; 0 where it has fewer units, so that a short text is judged like a long one."""
    out = np.zeros((len(offsets) - 1, BEST))
    if not len(code):
        return out
    value = np.clip(model.units(known), 0.0, 1.0)
    hit = np.flatnonzero(value[code] > 0.0)
    doc = np.searchsorted(offsets, hit, "right") - 1
    v = value[code[hit]]
    order = np.lexsort((-v, doc))
    doc, v = doc[order], v[order]
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
    keep = rank < BEST
    out[doc[keep], rank[keep]] = v[keep]
    return out


def held_out() -> F.Column:
    return F.expr("crc32(cast(doc_id as string)) % 3") == 1


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> tuple[list[str], list[int]]:
    """At most ``limit`` labelled documents outside the held-out fold, chosen by a
    hash of their ids, toxic ones up to half of them."""
    own = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(11))
    taken = own.where("toxic = 1").orderBy(order).limit(limit // 2).unionAll(own.where("toxic <> 1").orderBy(order).limit(limit // 2))
    rows = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id")  # at most ``limit`` ids
    got = rows.dropDuplicates(["doc_id"]).orderBy(order).select(F.coalesce("text", F.lit("")), "toxic").collect()
    return [r[0] for r in got], [int(r[1] == 1) for r in got]


def score(docs: DataFrame, model: Model, predicted_from: float = 0.7) -> DataFrame:
    """doc_id, score and prediction of every document row, over its whole text.

    The score is a logistic function of the largest decision values over the units of
    the text's sentences. Null, empty and wordless texts score lowest; null or repeated
    doc_ids keep their rows; other columns are ignored; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.slices(batches, "text"):
            p = model.probability(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(p), pa.array((p >= predicted_from).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, predicted int")


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> Model:
    model = train(*training_rows(docs, labels, limit))
    tokens.give_back()
    return model


def drop_toxic(docs: DataFrame, model: Model, predicted_from: float = 0.7) -> DataFrame:
    """The document rows that score below the threshold, columns unchanged; no shuffle."""
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.slices(batches, "text"):
            keep = model.probability(batch.column("text")) < predicted_from
            yield batch.filter(pa.array(keep)).select(names)

    return docs.mapInArrow(run, schema)
