"""Mixing sources to target weights by soft membership.

A classifier trained on the labelled table predicts, from byte pairs of the whole
text, the posterior of each domain (a pair of quality and toxicity labels). Document
rates r_i >= 0 are then fitted so that the expected tokens of each domain,
sum_i r_i t_i p_i, come as near to the targets as least squares allows, starting from
rate 1, by accelerated projected gradient. Every step moves a rate by a fixed function
of its posterior, so rates are never stored on the way: a task replays the steps.

The step length comes from the largest eigenvalue of sum_i t_i p_i p_i', a distributed
sum. Between two passes over the documents a stretch of steps is worked out on a grid
of posteriors (a distributed sum of tokens per cell, of bounded size, over all
documents); each pass then measures the exact totals at the rates reached, and what the
grid got wrong is added to every later gradient. The fit ends when a further exact step
would move no rate by more than a tolerance, and states that movement.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import tokens
from newsloom.llm.common import durable

HASHED = 1024
MAX_TRAIN = 4_000  # labelled documents in the training sample, at most
PASSES = 40  # over the documents, at most
STRETCH = 150  # steps between two passes
MOVED = 1e-5  # largest change of a rate by a further step at which the fit ends
CELLS = 20_000  # of the grid, about
_CHUNK, _ROWS = 1 << 18, 512  # bytes and texts that are counted at a time


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(one row of hashed byte-pair weights per text, its tokens); null is empty.

    A row holds square roots of pair shares (unit length) and a constant. Tokens are
    white-space separated words.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.string()), "")
    n_tokens = pc.list_value_length(pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))).to_numpy(zero_copy_only=False).astype(np.int64)
    n_tokens[pc.equal(pc.utf8_trim_whitespace(texts), "").to_numpy(zero_copy_only=False)] = 0
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    data = np.frombuffer("".join(texts.to_pylist()).encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros((len(texts), HASHED + 1), np.float32)
    out[:, -1] = 1
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = min(start + _ROWS, max(start + 1, int(np.searchsorted(ends, base + _CHUNK, "right"))))
        part = data[base : ends[stop - 1]].astype(np.uint32)
        doc = np.repeat(np.arange(stop - start), size[start:stop])
        if len(part) > 1:
            code = ((part[:-1] * np.uint32(257) + part[1:]) * np.uint32(2654435761)) >> np.uint32(22)
            inside = doc[:-1] == doc[1:]
            seen = np.bincount((doc[:-1] * HASHED + code)[inside], minlength=(stop - start) * HASHED).reshape(-1, HASHED)
            out[start:stop, :HASHED] = np.sqrt(seen / np.maximum(size[start:stop, None] - 1, 1))
        start = stop
    return out, n_tokens


@dataclass
class Classifier:
    domains: list[str]
    weights: np.ndarray  # features x domains

    def posterior(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return (z / z.sum(axis=1, keepdims=True)).astype(np.float64)


def train(texts: list[str], domains: list[str], rounds: int = 300) -> Classifier:
    """Multinomial logistic regression by accelerated gradient descent."""
    names = sorted(set(domains)) or ["all"]
    x = np.empty((len(texts), HASHED + 1), np.float32)
    for a in range(0, len(texts), _ROWS):  # the driver holds the counts of a few texts at a time
        x[a : a + _ROWS] = features(pa.array(texts[a : a + _ROWS], pa.string()))[0]
    x[:, :-1] *= 4
    w = np.zeros((x.shape[1], len(names)), np.float32)
    if len(names) > 1:
        y = np.eye(len(names), dtype=np.float32)[[names.index(d) for d in domains]]
        step = 2 * len(x) / (np.linalg.norm(x, 2) ** 2)
        v = w.copy()
        for t in range(rounds):
            z = x @ v
            z = np.exp(z - z.max(axis=1, keepdims=True))
            grad = x.T @ (z / z.sum(axis=1, keepdims=True) - y) / len(x) + 1e-5 * v
            new = v - step * grad
            v = new + t / (t + 3) * (new - w)
            w = new
    w[:-1] *= 4
    return Classifier(names, w)


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> tuple[list[str], list[str]]:
    """At most ``limit`` labelled documents, chosen by a hash of their ids."""
    own = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min(F.concat(F.lit("q"), "quality", F.lit("t"), "toxic")).alias("domain"))
    order = F.xxhash64("doc_id", F.lit(17))
    taken = own.orderBy(order).limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id").dropDuplicates(["doc_id"])  # at most ``limit`` ids
    got = rows.orderBy(order).select(F.coalesce("text", F.lit("")), "domain").collect()
    return [r[0] for r in got], [r[1] for r in got]


@dataclass
class Rates:
    """The fitted steps: a rate and its predecessor start at 1; each step (momentum m,
    move g) takes y = rate + m (rate - predecessor) to max(0, y - posterior . g)."""

    domains: list[str]
    targets: np.ndarray
    steps: list[tuple[float, np.ndarray]] = field(default_factory=list)
    totals: np.ndarray | None = None  # expected tokens of the domains at these rates
    moved: float = np.inf  # the most that one more step would change a rate
    error: float = np.inf  # distance from the targets, as a share of their sum

    def both(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = last = np.ones(len(p))
        for m, g in self.steps:
            r, last = _step(r, last, p, m, g)
        return r, last

    def of(self, p: np.ndarray) -> np.ndarray:
        return np.concatenate([self.both(p[a : a + 4096])[0] for a in range(0, len(p), 4096)]) if len(p) else np.ones(0)


def _step(r: np.ndarray, last: np.ndarray, p: np.ndarray, m: float, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(0.0, r + m * (r - last) - p @ g), r


def _levels(d: int) -> int:
    """The finest grid whose cells number about CELLS at most."""
    levels = 2
    while levels < 1024 and math.comb(levels + d, d - 1) <= CELLS:
        levels += 1
    return levels


def _grid(members: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, mean posterior) of the cells of a grid of posteriors that hold tokens."""
    levels = _levels(d)
    names = ["cell", "t", *(f"s{k}" for k in range(d))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, np.ndarray] = {}
        for batch in batches:
            p, t = _arrays(batch, d)
            cells, at = np.unique(np.rint(p * levels).astype("<i4"), axis=0, return_inverse=True)
            sums = np.zeros((len(cells), d + 1))
            np.add.at(sums, at.ravel(), np.column_stack([t, p * t[:, None]]))
            for cell, own in zip(cells, sums):
                key = cell.tobytes()
                seen[key] = seen[key] + own if key in seen else own
        rows = np.array(list(seen.values())).reshape(-1, d + 1)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), *(pa.array(rows[:, k].copy()) for k in range(d + 1))], names=names)

    cells = members.mapInArrow(run, "cell binary, t double" + "".join(f", s{k} double" for k in range(d)))
    rows = np.array([list(r) for r in cells.groupBy("cell").agg(*(F.sum(c).alias(c) for c in names[1:])).drop("cell").collect()])  # about CELLS rows
    rows = rows.reshape(-1, d + 1)
    rows = rows[rows[:, 0] > 0]
    return rows[:, 0], rows[:, 1:] / rows[:, :1]


def _arrays(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    p = batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return p, batch.column("n_tokens").to_numpy(zero_copy_only=False).astype(np.float64)


def _measure(members: DataFrame, rates: Rates, move: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Exact sums over all documents at these rates: expected tokens of the domains,
    sum t p p', and the largest change of a rate by the further step ``move``."""
    d = len(rates.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, most = np.zeros(d + d * d), 0.0
        for batch in batches:
            whole, tokens_ = _arrays(batch, d)
            for a in range(0, len(whole), 4096):
                p, t = whole[a : a + 4096], tokens_[a : a + 4096]
                r, _ = rates.both(p)
                total += np.concatenate([(r * t) @ p, ((p * t[:, None]).T @ p).ravel()])
                if move is not None and (t > 0).any():
                    most = max(most, float(np.abs(np.maximum(0.0, r - p @ move) - r)[t > 0].max()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total) + 1), pa.int32()), pa.array(np.append(total, most))], names=["k", "x"])

    out = np.zeros(d + d * d + 1)
    sums = members.mapInArrow(run, "k int, x double").groupBy("k").agg(F.sum("x"), F.max("x"))
    for k, x, m in sums.collect():  # domains squared rows
        out[k] = m if k == d + d * d else x
    return out[:d], out[d:-1].reshape(d, d), float(out[-1])


def fit_rates(members: DataFrame, domains: list[str], weights: dict[str, float], total: float | None = None, passes: int = PASSES) -> Rates:
    """Least-squares rates for rows (n_tokens bigint, p array<double>).

    ``weights``: target share of each domain (missing ones 0, scaled to 1); ``total``:
    target tokens, by default as many as there are. Targets out of reach are approached
    as near as nonnegative rates can. Without tokens all rates stay 1.
    """
    d = len(domains)
    rates = Rates(domains, np.zeros(d))
    have, gram, _ = _measure(members, rates)
    share = np.array([max(0.0, weights.get(x, 0.0)) for x in domains])
    share = share / share.sum() if share.sum() else np.full(d, 1.0 / d)
    rates.targets = share * (have.sum() if total is None else total)
    rates.totals = have
    size = max(float(rates.targets.sum()), 1.0)
    steepest = float(np.linalg.eigvalsh(gram)[-1])
    if steepest <= 0:
        rates.moved, rates.error = 0.0, float(np.linalg.norm(have - rates.targets)) / size
        return rates
    t, p = _grid(members, d)
    weighed = p * t[:, None]
    r = last = np.ones(len(p))
    pace = 1.0
    for _ in range(passes):
        off = have - r @ weighed  # what the grid gets wrong at the rates reached
        for _ in range(STRETCH):
            following = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
            m = (pace - 1) / following
            y = r + m * (r - last)
            g = (y @ weighed + off - rates.targets) / steepest
            new = np.maximum(0.0, y - p @ g)
            # momentum that leads uphill is dropped: the step is then a plain one
            if m and float((t * (y - new) * (new - r)).sum()) > 0:
                m, following = 0.0, 1.0
                g = (r @ weighed + off - rates.targets) / steepest
            rates.steps.append((m, g))
            pace = following
            r, last = _step(r, last, p, m, g)
            if float(np.abs(np.maximum(0.0, r - p @ ((r @ weighed + off - rates.targets) / steepest)) - r).max(initial=0.0)) < MOVED / 4:
                break
        guess = (r @ weighed + off - rates.targets) / steepest
        have, _, _ = _measure(members, rates)
        move = (have - rates.targets) / steepest
        rates.totals, rates.error = have, float(np.linalg.norm(have - rates.targets)) / size
        # the grid's rates lie within those of the documents of a cell: the exact
        # movement needs one more look at them, only when it may end the fit
        if float(np.abs(move - guess).max()) < MOVED:
            _, _, rates.moved = _measure(members, rates, move)
            if rates.moved < MOVED:
                break
    if not np.isfinite(rates.moved):
        _, _, rates.moved = _measure(members, rates, move)
    return rates


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, n_tokens, p of every document row; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.slices(batches, "text"):
            for own in _parts(batch):
                x, n = features(own.column("text"))
                p = model.posterior(x)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([own.column("doc_id").cast(pa.int64()), pa.array(n), flat], names=["doc_id", "n_tokens", "p"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, p array<double>")


def _parts(batch: pa.RecordBatch, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def fit(docs: DataFrame, labels: DataFrame, weights: dict[str, float], total: float | None = None) -> tuple[Classifier, Rates, DataFrame]:
    """The classifier, the rates, and the memberships as a written table."""
    model = train(*training_rows(docs, labels))
    tokens.give_back()
    members = durable(memberships(docs, model), "memberships")
    return model, fit_rates(members.select("n_tokens", "p"), model.domains, weights, total), members


def document_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float], total: float | None = None) -> DataFrame:
    """doc_id, n_tokens, rate, copies and the posteriors (one column per domain, as
    p_<domain>) of every document row.

    copies is the whole number at or next above the rate that a hash of the doc_id
    chooses, so that its expectation is the rate. Empty texts have no tokens and still
    a rate; null or repeated doc_ids keep their rows; other columns are ignored; no
    rows give no rows, and without labels all documents are one domain.
    """
    model, rates, members = fit(docs, labels, weights, total)
    d = len(model.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            r = rates.of(p)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_tokens"), pa.array(r), *(pa.array(p[:, k].copy()) for k in range(d))], names=names)

    names = ["doc_id", "n_tokens", "rate", *(f"p_{x}" for x in model.domains)]
    schema = "doc_id bigint, n_tokens bigint, rate double" + "".join(f", p_{x} double" for x in model.domains)
    out = members.mapInArrow(run, schema)
    return out.withColumn("copies", F.floor(F.col("rate") + chance()).cast("int"))


def chance() -> F.Column:
    """A number in [0, 1) that depends on the doc_id alone."""
    return F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 32)) / F.lit(float(1 << 32))


def apply_rates(docs: DataFrame, model: Classifier, rates: Rates) -> DataFrame:
    """Each document as many times as its rate says, columns unchanged; the posterior
    is worked out again from the text, so nothing is shuffled.

    Null texts are empty and have a rate like others; repeated or null doc_ids keep
    their rows and share the chance of rounding up; columns of any name pass through;
    no rows give no rows. Copies leave in batches of bounded size.
    """
    names, schema = docs.columns, docs.schema
    lot = "_chance"
    while lot in names:
        lot += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.slices(batches, "text"):
            for own in _parts(batch):
                x, _ = features(own.column("text"))
                r = rates.of(model.posterior(x))
                u = own.column(lot).to_numpy(zero_copy_only=False)
                at = np.repeat(np.arange(len(r)), np.floor(r + u).astype(np.int64))
                size = pc.fill_null(pc.binary_length(own.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)[at].cumsum()
                own = own.select(names)
                start = 0
                while start < len(at):
                    stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + tokens._BATCH_BYTES, "right")))
                    yield own.take(pa.array(at[start:stop]))
                    start = stop

    return docs.withColumn(lot, chance()).mapInArrow(run, schema)
