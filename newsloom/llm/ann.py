"""Approximate nearest neighbours with balanced posting lists.

Centroids come from balanced k-means on a bounded sample and are searched through an
in-memory neighbour graph. Every vector goes to its nearest list and, if it lies near
a boundary, to further lists whose centroids are almost as near and not shadowed by a
chosen one. A query reads the lists whose centroid distance is within a ratio of the
nearest, and as many of them as a block of held queries needs: their true neighbours
are found by comparing them with every row, and the lists read grow, up to all of them,
until RECALL of these neighbours are met. A query whose lists hold too few vectors
reads all lists. Neighbouring lists share a shelf, and a task reads the lists of a shelf
for a block of queries and returns one top-k for them all, so candidates do not grow
with the lists read. Shelves are cut into blocks by vector, so a vector that a third of
all rows repeat fills many blocks and no task; every row is indexed, the sample only
places the centroids, whose number grows with the table up to MOST_LISTS.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import vectors
from newsloom.llm.common import durable

SAMPLE = 65_536  # vectors that place the centroids, at most
LIST = 256  # vectors aimed at per list
MOST_LISTS = 8_192
REPLICAS = 4
CLOSURE = 1.12  # boundary vectors go to lists within this ratio of the nearest
PRUNE = 1.35  # queries read lists within this ratio of the nearest
PROBES = 64  # lists a query reads before any are added
SHELF = 32  # lists on a shelf
BLOCK, QUERY_BLOCK = 32_768, 1_024
HELD = 256  # queries whose true neighbours are found to measure recall
RECALL = 0.95  # aimed at on the held queries
WIDEST = 4.0  # ratio beyond which none is asked for
_ROWS = 2_048  # of a matrix of distances to all centroids


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale  # no overflow or underflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k-means whose assignment cost has a penalty for lists over the mean size."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:lists]].copy()
    size, mean = np.zeros(len(c)), len(x) / max(len(c), 1)
    spread = None
    for _ in range(rounds):
        own, nearest = np.empty(len(x), np.int64), np.empty(len(x), x.dtype)
        for a in range(0, len(x), _ROWS):
            d = 2 - 2 * x[a : a + _ROWS] @ c.T
            if spread is None:
                spread = np.median(d.min(axis=1)) + 1e-12
            own[a : a + _ROWS] = at = (d + 0.2 * spread * np.minimum(size / mean, 4)).argmin(axis=1)
            nearest[a : a + _ROWS] = d[np.arange(len(d)), at]
        spread = np.median(nearest) + 1e-12
        size = np.bincount(own, minlength=len(c)).astype(float)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        empty = size == 0
        if empty.any():  # restart at the vectors worst served
            far = np.argsort(-nearest, kind="stable")[: int(empty.sum())]
            total[np.flatnonzero(empty)[: len(far)]] = x[far]
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c)
    return c


def shelves(centroids: np.ndarray, lists: int = SHELF) -> np.ndarray:
    """The shelf of each centroid: halves along the widest direction, until a part has
    at most so many lists."""
    out = np.zeros(len(centroids), np.int32)
    todo, n = [np.arange(len(centroids))], 0
    while todo:
        own = todo.pop()
        if len(own) <= lists:
            out[own], n = n, n + 1
            continue
        x = centroids[own] - centroids[own].mean(axis=0)
        order = np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")
        todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return out


class Graph:
    """Neighbour graph over centroids with a best-first search from fixed entries."""

    def __init__(self, centroids: np.ndarray, degree: int = 16, radius: float = 0.0):
        self.c = centroids
        self.radius = radius  # the usual distance of a vector from its list's centroid
        self.shelf = shelves(centroids)
        n = len(centroids)
        near = np.concatenate([np.argsort(-(centroids[a : a + _ROWS] @ centroids.T), axis=1, kind="stable")[:, : degree + 1] for a in range(0, n, _ROWS)])
        links = [set(row.tolist()) - {i} for i, row in enumerate(near)]
        for i, row in enumerate(near):  # both ways, so that hubs lead back
            for j in row[1:]:
                if len(links[j]) < 2 * degree:
                    links[j].add(i)
        rng = np.random.default_rng(1)
        for i in range(n):  # long links keep the graph in one piece
            links[i] |= set(rng.integers(0, n, 4).tolist()) - {i}
        wide = max(map(len, links), default=0) or 1
        self.links = np.array([[*sorted(s), *[i] * (wide - len(s))] for i, s in enumerate(links)])
        self.entries = rng.permutation(n)[: min(n, 24)]

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Per row of unit vectors: centroid numbers and distances, nearest first; -1
        and infinity where fewer were met."""
        n = len(self.c)
        width = min(width, n)
        if 8 * width >= n:  # so wide a search meets most centroids: compare with all
            d = 2 - 2 * q @ self.c.T
            order = np.argsort(d, axis=1, kind="stable")[:, :width]
            return order, np.sqrt(np.maximum(np.take_along_axis(d, order, 1), 0))
        d = np.full((len(q), n), np.inf, np.float32)  # n is at most MOST_LISTS
        done = np.zeros((len(q), n), bool)
        rows = np.arange(len(q))
        d[:, self.entries] = 2 - 2 * q @ self.c[self.entries].T
        live = rows
        for _ in range(4 * width):
            open_d = np.where(done[live], np.inf, d[live])
            at = open_d.argmin(axis=1)
            # stop when the nearest open one lies beyond the width-th best
            kth = np.partition(d[live], width - 1, axis=1)[:, width - 1]
            go = np.isfinite(open_d[np.arange(len(live)), at]) & (open_d[np.arange(len(live)), at] <= kth)
            live, at = live[go], at[go]
            if not len(live):
                break
            done[live, at] = True
            near = self.links[at]
            d[live[:, None], near] = 2 - 2 * np.einsum("ij,ikj->ik", q[live], self.c[near])
        order = np.argsort(d, axis=1, kind="stable")[:, :width]
        dist = np.sqrt(np.maximum(np.take_along_axis(d, order, 1), 0))
        return np.where(np.isfinite(dist), order, -1), dist


def _choose(graph: Graph, q: np.ndarray, ratio: float, most: int, shadow: bool) -> list[np.ndarray]:
    near, dist = graph.search(q, min(most if not shadow else 2 * most, len(graph.c)))
    out = []
    for at, d in zip(near, dist):
        # a query at its own centroid still reaches as far as others
        nearest = d[0] if shadow else max(d[0], graph.radius)
        keep = (at >= 0) & (d <= (ratio * nearest + 1e-9 if np.isfinite(ratio) else np.inf))
        at, d = at[keep], d[keep]
        if shadow:
            chosen: list[int] = []
            for c, own in zip(at.tolist(), d.tolist()):
                if all(2 - 2 * self_dot >= own * own for self_dot in (graph.c[chosen] @ graph.c[c] if chosen else [])):
                    chosen.append(c)
                if len(chosen) == most:
                    break
            at = np.array(chosen)
        out.append(at[:most])
    return out


def _routed(rows: DataFrame, graph: Graph, ratio: float, most: int, shadow: bool) -> DataFrame:
    """(shelf, vec_id, v, lists) of every row: a row for each shelf that it meets, with
    its lists there."""

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pages:
            for a in range(0, len(pdf), 1024):
                part = pdf.iloc[a : a + 1024]
                chosen = _choose(graph, unit(vectors.matrix(part["v"])).astype(np.float32), ratio, most, shadow)
                at = np.repeat(np.arange(len(part)), [len(x) for x in chosen])
                lists = np.concatenate(chosen).astype(np.int32)
                shelf = graph.shelf[lists]
                order = np.lexsort((lists, shelf, at))
                at, lists, shelf = at[order], lists[order], shelf[order]
                first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (shelf[1:] != shelf[:-1]))) if len(at) else np.zeros(0, np.int64)
                yield pd.DataFrame({"shelf": shelf[first], "vec_id": part["vec_id"].to_numpy()[at[first]], "v": part["v"].to_numpy()[at[first]], "lists": np.split(lists, first[1:]) if len(first) else []})

    return rows.select("vec_id", "v").mapInPandas(run, "shelf int, vec_id bigint, v array<double>, lists array<int>")


def _found(ids: np.ndarray, x: np.ndarray, own: np.ndarray, y: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """query_id, vec_id, score: the k best rows x for every query y, its own left out."""
    out = {"query_id": [], "vec_id": [], "score": []}
    if len(ids) and len(own):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], unit(x[order])
        y = unit(y)
        for a in range(0, len(y), 256):
            s = y[a : a + 256] @ x.T
            s[own[a : a + 256, None] == ids[None, :]] = -np.inf
            at = vectors.best(s, ids, min(k + 1, len(ids)))
            got = np.take_along_axis(s, at, 1)
            keep = np.isfinite(got)
            # one order of summation for every pair, whatever its block
            r, c = np.nonzero(keep)
            out["query_id"].append(own[a + r])
            out["vec_id"].append(ids[at[r, c]])
            out["score"].append(_cosine(y[a + r], x[at[r, c]]))
    return {c: np.concatenate(z) if z else [] for c, z in out.items()}


def _true(rows: DataFrame, held: pd.DataFrame, k: int) -> pd.DataFrame:
    """query_id, v: the vectors of the k true neighbours of each held query."""
    own, y = held["vec_id"].to_numpy(), vectors.matrix(held["v"])

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = []
        for pdf in pages:
            page = pd.DataFrame(_found(pdf["vec_id"].to_numpy(), vectors.matrix(pdf["v"]), own, y, k))
            top = [pd.concat([*top, page]).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)]
        yield from top

    found = vectors.ranked(rows.mapInPandas(run, vectors.TOP.format("double")), k)
    # at most k rows for each of HELD queries
    return rows.join(F.broadcast(found.select("query_id", "vec_id")), "vec_id").select("query_id", "v").toPandas()


def _reach(graph: Graph, held: pd.DataFrame, true: pd.DataFrame, share: np.ndarray) -> tuple[float, int]:
    """Ratio and number of lists that meet RECALL of the true neighbours of the held
    queries: as many lists as needed, then as wide a ratio. ``share``: of the rows in
    each list; where the lists of a usual query hold as many vectors as the table (they
    share boundary vectors), pruning saves nothing and all lists are read."""
    if not len(true):
        return PRUNE, PROBES
    ask = unit(vectors.matrix(held["v"])).astype(np.float32)
    row = pd.Series(range(len(held)), index=held["vec_id"]).loc[true["query_id"]].to_numpy()
    home = _choose(graph, unit(vectors.matrix(true["v"])).astype(np.float32), CLOSURE, REPLICAS, True)
    ratio, probes = PRUNE, min(PROBES, len(graph.c))
    while True:
        read = _choose(graph, ask, ratio, probes, False)
        if np.mean([share[x].sum() for x in read]) >= 1 or not np.isfinite(ratio):
            return np.inf, len(graph.c)
        if np.mean([np.isin(h, read[r]).any() for r, h in zip(row, home)]) >= RECALL:
            return ratio, probes
        if probes < len(graph.c):
            probes = min(len(graph.c), probes + max(1, probes // 4))
        else:
            ratio = ratio * 1.1 if ratio < WIDEST else np.inf


def nearest(embeddings: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest cosines found for every query.

    Queries are the rows whose vec_id is divisible by 50, candidates all others than
    the query's own. Vectors null, zero, or with null or non-finite components take
    no part; rows that share a vec_id count once; a null vec_id takes no part; ties go
    to the smaller vec_id; other columns are ignored; an empty table gives no rows.
    """
    spark = embeddings.sparkSession
    rows = durable(vectors.usable(embeddings, nonzero=True), "vectors")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(2))).limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    u = unit(sample.flatten().to_numpy(zero_copy_only=False).reshape(len(sample), -1)).astype(np.float32)
    del sample
    x = np.unique(u, axis=0)
    lists = max(1, min(MOST_LISTS, len(x) // 8, -(-n // LIST)))
    centroids = balanced_centroids(x, lists)  # at most MOST_LISTS
    own = np.concatenate([(2 - 2 * u[a : a + _ROWS] @ centroids.T).min(axis=1) for a in range(0, len(u), _ROWS)])
    graph = Graph(centroids, radius=float(np.sqrt(np.maximum(np.median(own), 0))))
    reach = PRUNE, PROBES
    if lists > 1:
        held = rows.where(vectors.is_query()).orderBy(F.xxhash64("vec_id", F.lit(4))).limit(HELD).toPandas()
        if len(held):
            part = u[:_ROWS]  # in the order of a hash: enough for the shares of the lists
            share = np.bincount(np.concatenate(_choose(graph, part, CLOSURE, REPLICAS, True)), minlength=len(graph.c)) / len(part)
            reach = _reach(graph, held, _true(rows, held, k), share)
    asked = durable(rows.where(vectors.is_query()), "queries")
    posted = durable(_routed(rows, graph, CLOSURE, REPLICAS, True), "posted")
    found = durable(_searched(posted, durable(_routed(asked, graph, *reach, False), "asked"), k), "nearest")
    # lists of few vectors can leave a query short: it reads them all
    short = durable(asked.join(found.where(F.col("rank") == min(k, n - 1)).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti"), "short")
    if short.isEmpty():
        return found
    again = _searched(posted, durable(_routed(short, graph, np.inf, lists, False), "asked"), k)
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)


def _searched(posted: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    q_size = asked.groupBy("shelf").agg(F.ceil(F.count("*") / F.lit(QUERY_BLOCK)).cast("int").alias("_qb"))
    sizes = posted.groupBy("shelf").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("_vb")).join(q_size, "shelf")
    sizes = F.broadcast(durable(sizes, "shelves"))  # fewer rows than lists
    v = vectors.deal(posted, sizes, ["shelf"], "vb", "qb")
    q = vectors.deal(asked, sizes, ["shelf"], "qb", "vb")

    def search(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_best_of_lists(v, q, k))

    found = v.groupBy("shelf", "vb", "qb").cogroup(q.groupBy("shelf", "vb", "qb")).applyInPandas(search, vectors.TOP.format("double"))
    return vectors.ranked(found, k)


def _members(lists: pd.Series) -> dict[int, np.ndarray]:
    """Row numbers by list."""
    flat = np.concatenate(lists.to_list()) if len(lists) else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    order = np.argsort(flat, kind="stable")
    names, first = np.unique(flat[order], return_index=True)
    return dict(zip(names.tolist(), np.split(row[order], first[1:])))


def _best_of_lists(v: pd.DataFrame, q: pd.DataFrame, k: int) -> dict[str, np.ndarray]:
    """The k best vectors of each query over the lists that it reads."""
    out = {"query_id": [], "vec_id": [], "score": []}
    if len(v) and len(q):
        ids, x, own, y = v["vec_id"].to_numpy(), vectors.matrix(v["v"]), q["vec_id"].to_numpy(), vectors.matrix(q["v"])
        there, asking = _members(v["lists"]), _members(q["lists"])
        found = [_found(ids[there[z]], x[there[z]], own[asking[z]], y[asking[z]], k) for z in asking.keys() & there.keys()]
        every = {c: np.concatenate([f[c] for f in found if len(f["query_id"])] or [np.zeros(0)]) for c in out}
        order = np.lexsort((every["vec_id"], -every["score"], every["query_id"]))
        every = {c: z[order] for c, z in every.items()}
        # a boundary vector is met in several lists
        new = np.append(True, (np.diff(every["query_id"]) != 0) | (np.diff(every["vec_id"]) != 0)) if len(order) else np.zeros(0, bool)
        every = {c: z[new] for c, z in every.items()}
        start = np.append(True, np.diff(every["query_id"]) != 0) if len(every["query_id"]) else np.zeros(0, bool)
        place = np.arange(len(start)) - np.maximum.accumulate(np.where(start, np.arange(len(start)), 0)) if len(start) else start
        return {c: z[place < k] for c, z in every.items()} if len(start) else out
    return out


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.clip(np.einsum("ij,ij->i", a, b), -1.0, 1.0)
