"""Exact top-k inner products by ball-tree branch and bound.

Vectors are dealt into shards by a hash. Each shard builds a ball tree; the inner
product of a query with anything in a node is at most q.centre + |q| radius. A first
pass visits only each shard's most promising leaf; the k-th best of what all shards
found is a score that the answer reaches at least. The second pass starts every shard
from that shared score, visits nodes from the largest bound down and stops at the
first that is below the current k-th score. Scores are integers; nothing is estimated.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm import vectors
from newsloom.llm.common import durable

SHARD, QUERY_BLOCK, LEAF = 16_384, 1_024, 128
EXACT = 2**53


class BallTree:
    """Nodes split at the median of the widest direction; leaves of at most LEAF rows."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.x, self.ids = x[order], ids[order]
        self.left, self.right, self.members, centres, radii = [], [], [], [], []

        def build(at: np.ndarray) -> int:
            node = len(self.left)
            self.left.append(-1)
            self.right.append(-1)
            own = self.x[at].astype(np.float64)
            centre = own.mean(axis=0)
            centres.append(centre)
            radii.append(float(np.sqrt(((own - centre) ** 2).sum(axis=1).max())))
            self.members.append(at if len(at) <= LEAF else None)
            if len(at) > LEAF:
                far = own[((own - centre) ** 2).sum(axis=1).argmax()]
                other = own[((own - far) ** 2).sum(axis=1).argmax()]
                side = np.argsort(own @ (other - far), kind="stable")
                self.left[node] = build(np.sort(at[side[: len(at) // 2]]))
                self.right[node] = build(np.sort(at[side[len(at) // 2 :]]))
            return node

        build(np.arange(len(ids)))
        self.centres, self.radii = np.array(centres), np.array(radii)
        big = int(np.abs(self.x).max(initial=0))
        self.floats = self.x.astype(np.float64) if big < 2**26 else None

    def scores(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        # float sums of integers below 2**53 are exact
        if self.floats is not None and np.abs(q).max(initial=0) < 2**26 and len(self.x[0]) * float(np.abs(q).max(initial=0)) * float(np.abs(self.floats[at]).max(initial=0)) < EXACT:
            return (q.astype(np.float64) @ self.floats[at].T).astype(np.int64)
        return q @ self.x[at].T

    def bounds(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        f = q.astype(np.float64)
        norm = np.linalg.norm(f, axis=1)
        up = f @ self.centres[nodes].T + norm[:, None] * self.radii[nodes]
        return up + 1e-9 * (np.abs(up) + norm[:, None] * (self.radii[nodes] + np.linalg.norm(self.centres[nodes], axis=1))) + 1

    def search(self, q: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray | None, first_only: bool) -> tuple[list[np.ndarray], list[np.ndarray], int]:
        """Per query (ids, scores), best first, and the number of leaves visited.
        ``floor``: scores known to be reached; lesser bounds are cut."""
        kth = np.full(len(q), np.iinfo(np.int64).min) if floor is None else floor.copy()
        ids = [np.zeros(0, np.int64) for _ in q]
        got = [np.zeros(0, np.int64) for _ in q]
        # frontier: down the tree level by level, cutting nodes below every bound
        leaves, bound, visits = [], [], 0
        live = np.array([0])
        while len(live):
            up = self.bounds(q, live)
            keep = (up >= kth[:, None]).any(axis=0)
            up, live = up[:, keep], live[keep]
            is_leaf = np.array([self.members[n] is not None for n in live], bool)
            leaves += live[is_leaf].tolist()
            bound.append(up[:, is_leaf])
            live = np.array([c for n in live[~is_leaf] for c in (self.left[n], self.right[n])], np.int64)
        if not leaves:
            return ids, got, 0
        up = np.concatenate(bound, axis=1)
        order = np.argsort(-up, axis=1, kind="stable")
        active = np.arange(len(q))
        for r in range(1 if first_only else len(leaves)):
            leaf = order[active, r]
            # leaves come from the largest bound down, so the first miss ends a query
            go = up[active, leaf] >= kth[active]
            active, leaf = active[go], leaf[go]
            if not len(active):
                break
            for n in np.unique(leaf):
                rows = active[leaf == n]
                at = self.members[leaves[n]]
                s = self.scores(q[rows], at)
                visits += len(rows)
                for j, row in enumerate(rows.tolist()):
                    fit = (s[j] >= kth[row]) & (self.ids[at] != own[row])
                    cand_i, cand_s = np.concatenate([ids[row], self.ids[at][fit]]), np.concatenate([got[row], s[j][fit]])
                    top = np.lexsort((cand_i, -cand_s))[:k]
                    ids[row], got[row] = cand_i[top], cand_s[top]
                    if len(top) == k:
                        kth[row] = max(kth[row], int(got[row][-1]))
        return ids, got, visits


def _pass(v: DataFrame, q: DataFrame, k: int, first_only: bool) -> DataFrame:
    def run(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(v) and len(q):
            tree = BallTree(np.stack(v["v"].to_numpy()).astype(np.int64), v["vec_id"].to_numpy())
            own = q["vec_id"].to_numpy()
            floor = None if first_only else q["floor"].fillna(np.iinfo(np.int64).min).to_numpy().astype(np.int64)
            ids, got, _ = tree.search(np.stack(q["v"].to_numpy()).astype(np.int64), own, k, floor, first_only)
            for i, found, scores in zip(own.tolist(), ids, got):
                out["query_id"] += [i] * len(found)
                out["vec_id"] += found.tolist()
                out["score"] += scores.tolist()
        return pd.DataFrame(out)

    keys = ["shard", "qb"]
    return v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(run, vectors.TOP.format("bigint"))


def top_inner_products(embeddings: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of the scaled,
    floored vectors for every query.

    Queries are the rows whose vec_id is divisible by 50, candidates all others than
    the query's own. Vectors null or with null or non-finite components take no part;
    rows that share a vec_id count once; a null vec_id takes no part; ties go to the
    smaller vec_id; other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.usable(embeddings, nonzero=False)
    rows = durable(rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("bigint")).alias("v")), "scaled")
    n, m = rows.agg(F.count("*"), F.count(F.when(vectors.is_query(), 1))).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-m // QUERY_BLOCK))
    # every shard meets every block of queries: small blocks, dealt to as many tasks
    v = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(shards)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    q = rows.where(vectors.is_query()).select(F.col("vec_id").alias("vec_id"), F.col("v").alias("v")).withColumn("qb", F.pmod(F.xxhash64("vec_id", F.lit(4)), F.lit(blocks)).cast("int"))
    q = q.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    seen = durable(_pass(v, q, k, True), "first")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floor = seen.withColumn("r", F.row_number().over(w)).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    found = _pass(v, q.join(floor, "vec_id", "left"), k, False)
    return vectors.ranked(found, k)
