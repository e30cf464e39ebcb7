"""N-gram Jaccard self-join with Bayesian candidate pruning.

Exact copies (equal shingle sets) are folded to one class first. Candidates share a
band of MinHash values. A pair's values are then compared ``STEP`` at a time, and it
is dropped as soon as the posterior probability (uniform prior, binomial matches)
that its similarity reaches the threshold falls below ``TOLERANCE``; every pair that
is left is verified on the whole shingle sets.

Large groups of near copies never become rows of pairs: sets that agree with the
least set of a bucket are first drawn together into families (linear in the
buckets); sets of different families that outlast the pruning merge their families,
so every candidate pair lies inside one; and a family is compared block by block
inside tasks, which return link counts and a spanning forest.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from newsloom.llm import shingles, tokens
from newsloom.llm.common import BROADCAST_ROWS, components, durable, small_side

HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
STEP = 16
TOLERANCE = 1e-9
FAMILY = 0.6  # share of equal values with a bucket's least set that makes a family
BLOCK = 512
HUB = 16  # members of one family in a bucket from which they are compared apart


@functools.cache
def least_matches(threshold: float, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For n = STEP, 2 STEP, ... compared values: the fewest matches m for which
    P(similarity >= threshold | m of n) = P(Bin(n + 1, threshold) <= m) is not below
    the tolerance."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
        out.append(m)
    return tuple(out)


def prune(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Positions of the pairs (left[i], right[j]) of signatures that stay."""
    keep = np.arange(len(i))
    matches = np.zeros(len(i), np.int32)
    for k, least in enumerate(least_matches(threshold)):
        part = slice(k * STEP, (k + 1) * STEP)
        matches = matches + (left[i[keep], part] == right[j[keep], part]).sum(axis=1)
        stay = matches >= least
        keep, matches = keep[stay], matches[stay]
    return keep


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """Per document row: doc_id, set key, signature (32 low bits each), set size."""
    factors = shingles.hash_factors(HASHES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.slices(batches, "text", 6 << 20):
            flat, offsets = shingles.shingle(batch.column("text"), width)
            keys, sigs, sizes = [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                own = np.unique(flat[a:b])
                keys.append(shingles.set_key(own))
                sigs.append(shingles.signature(own, factors).tobytes())
                sizes.append(len(own))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int32())], names=["doc_id", "sk", "sig", "size"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, sk binary, sig binary, size int")


def bands(reps: DataFrame) -> DataFrame:
    """(band key, sk) rows of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mix = shingles._factors(ROWS)
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = shingles._finish((shingles._finish(sig + salt[:, None]) * mix).sum(axis=2, dtype=np.uint64) + salt)
            sk = batch.column("sk").take(pa.array(np.repeat(np.arange(len(sig)), BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), sk], names=["band", "sk"])

    return reps.where("size > 0").select("sk", "sig").mapInArrow(run, "band bigint, sk binary")


def _sigs(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(-1, HASHES)


def _family_edges(entries: DataFrame, stats: DataFrame, reps: DataFrame, name: str) -> DataFrame:
    """Sets and the least set of a bucket of theirs that they agree with."""
    star = entries.join(stats, "band").where("sk <> least").select("sk", "least").distinct()
    sig = reps.select("sk", "sig")
    both = star.join(sig, "sk").join(sig.select(F.col("sk").alias("least"), F.col("sig").alias("least_sig")), "least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sig", "least_sig"))
            near = pa.array((x == y).mean(axis=1) >= FAMILY)
            yield pa.RecordBatch.from_arrays([batch.column("sk").filter(near), batch.column("least").filter(near)], names=["a", "b"])

    return durable(both.select("sk", "sig", "least", "least_sig").mapInArrow(run, "a binary, b binary"), name)


def _blocked(members: DataFrame, group: str, size: DataFrame) -> DataFrame:
    """Deals each group's members into blocks and every pair of blocks to a key:
    (group, x, y), with ``side`` telling the block. Groups of one block get one key; only
    the sizes of the others are looked up, so that members are not dealt by group."""
    large = durable(size.where(F.col("members") > BLOCK).select(group, F.ceil(F.col("members") / F.lit(BLOCK)).cast("int").alias("_parts")), "large")
    dealt = members.join(small_side(large, large.count()), group, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    dealt = dealt.withColumn("_b", F.pmod(F.xxhash64("sk", F.lit(7)), F.col("_parts")).cast("int"))
    other = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return other.withColumn("x", F.least("_b", "_o")).withColumn("y", F.greatest("_b", "_o")).withColumn("side", F.col("_b")).drop("_b", "_o", "_parts")


def _block_pairs(x: int, y: int, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one task: all pairs i < j of a single block, or across two."""
    if x == y:
        i, j = np.triu_indices(len(side), 1)
        return i, j
    a, b = np.flatnonzero(side == x), np.flatnonzero(side == y)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def _cross_groups(entries: DataFrame, family: DataFrame) -> DataFrame:
    """(g, sk, label): groups in which sets of different labels are to be compared.

    A bucket of several families is a group. Where one family fills much of a bucket,
    its members leave it: they meet the bucket's other sets in one group of that
    family's own, whatever the number of buckets they share, so that a large family
    is laid out once and not once a band.
    """
    tagged = entries.join(family, "sk", "left").select("band", "sk", F.coalesce("family", "sk").alias("family"))
    part = tagged.groupBy("band", "family").agg(F.count("*").alias("c"))
    mixed = part.groupBy("band").agg(F.count("*").alias("families"), F.max(F.struct("c", "family")).alias("top")).where("families > 1")
    mixed = mixed.select("band", F.when(F.col("top.c") >= HUB, F.col("top.family")).alias("hub"))
    rows = durable(tagged.join(mixed, "band"), "mixed")
    rest = rows.where("hub is null or family <> hub").select(F.concat(F.lit("b"), F.col("band")).alias("g"), "sk", F.hex("family").alias("label"))
    strays = rows.where("family <> hub").select(F.concat(F.lit("h"), F.hex("hub")).alias("g"), "sk", F.lit("").alias("label")).distinct()
    hubs = rows.where("hub is not null").select("hub").distinct()
    core = family.join(hubs, F.col("family") == F.col("hub")).select(F.concat(F.lit("h"), F.hex("family")).alias("g"), "sk", F.hex("family").alias("label"))
    return rest.unionByName(strays).unionByName(core)


def _cross_edges(groups: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different labels in a group that outlast the pruning, thinned to a
    spanning forest of each task: enough to merge their families."""
    size = durable(groups.groupBy("g").agg(F.count("*").alias("members"), F.min("label").alias("lo"), F.max("label").alias("hi")), "sizes")
    alone = size.where("lo = hi").select("g")
    groups = groups.join(small_side(alone, alone.count()), "g", "left_anti")
    dealt = _blocked(groups, "g", size.where("lo <> hi")).join(reps.select("sk", "sig"), "sk")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sig, label, sk = _sigs(pdf["sig"]), pd.factorize(pdf["label"])[0], pdf["sk"].to_numpy()
        i, j = _block_pairs(key[1], key[2], pdf["side"].to_numpy())
        forest = Forest(len(sk))
        for a in range(0, len(i), 65_536):
            p, q = i[a : a + 65_536], j[a : a + 65_536]
            apart = label[p] != label[q]
            p, q = p[apart], q[apart]
            keep = prune(sig, sig, p, q, threshold)
            forest.add(p[keep], q[keep])
        p, q = forest.arrays()
        return pd.DataFrame({"a": sk[p], "b": sk[q]})

    return dealt.groupBy("g", "x", "y").applyInPandas(run, "a binary, b binary")


class Forest:
    """Union-find over numbers that keeps the edges which joined two trees."""

    def __init__(self, n: int):
        self.root = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def _find(self, k: int) -> int:
        root = self.root
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        for u, v in zip(p.tolist(), q.tolist()):
            ru, rv = self._find(u), self._find(v)
            if ru != rv:
                self.root[ru] = rv
                self.edges.append((u, v))

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        e = np.array(self.edges, np.int64).reshape(-1, 2)
        return e[:, 0], e[:, 1]


def _merged(family: DataFrame, cross: DataFrame) -> DataFrame:
    """(g, sk): the families joined along the cross edges; sets without a family that
    have such an edge are families of one first."""
    lone = cross.select(F.explode(F.array("a", "b")).alias("sk")).distinct().join(family, "sk", "left_anti").select("sk", F.col("sk").alias("family"))
    every = durable(family.unionByName(lone), "every")
    name = lambda c, to: every.select(F.col("sk").alias(c), F.col("family").alias(to))
    links = cross.join(name("a", "fa"), "a").join(name("b", "fb"), "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    root = components(links, "merges").select(F.col("node").alias("family"), "root")
    return every.join(root, "family", "left").select(F.hex(F.coalesce("root", "family")).alias("g"), "sk")


def _verify(dealt: DataFrame, threshold: float) -> DataFrame:
    """Exact similarity inside each (g, x, y) task: rows (a, n, null) add n to the
    links of set a, rows (a, 0, b) are forest edges. Columns: sk, sig, set, copies."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("sk")
        sk, copies, sig = pdf["sk"].to_numpy(), pdf["copies"].to_numpy(), _sigs(pdf["sig"])
        i, j = _block_pairs(key[1], key[2], pdf["side"].to_numpy())
        sets = [np.frombuffer(x, "<u8") for x in pdf["set"]]
        size = np.array([len(x) for x in sets], np.int64)
        links, forest = np.zeros(len(sk), np.int64), Forest(len(sk))
        for a in range(0, len(i), 65_536):
            p, q = i[a : a + 65_536], j[a : a + 65_536]
            near = np.minimum(size[p], size[q]) >= threshold * np.maximum(size[p], size[q]) - 1e-9
            p, q = p[near], q[near]
            keep = prune(sig, sig, p, q, threshold)
            p, q = p[keep], q[keep]
            if not len(p):
                continue
            common = _common(sets, p, q)
            yes = common >= threshold * (size[p] + size[q] - common) - 1e-9
            p, q = p[yes], q[yes]
            np.add.at(links, p, copies[q])
            np.add.at(links, q, copies[p])
            forest.add(p, q)
        some = np.flatnonzero(links)
        u, v = forest.arrays()
        return pd.DataFrame({"a": [*sk[some], *sk[u]], "n": [*links[some], *[0] * len(u)], "b": [*[None] * len(some), *sk[v]]})

    return dealt.groupBy("g", "x", "y").applyInPandas(run, "a binary, n bigint, b binary")


def _common(sets: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[p] and sets[q]."""
    if len(p) <= 64:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(p.tolist(), q.tolist())], np.int64)
    used, back = np.unique(np.concatenate([p, q]), return_inverse=True)
    u, v = back[: len(p)], back[len(p) :]
    _, code = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True)
    which = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])
    # shingles in a single set never meet another; the rest as 0/1 rows, a few
    # thousand columns at a time, multiplied
    count = np.bincount(code)
    column = np.full(len(count), -1)
    shared = np.flatnonzero(count > 1)
    column[shared] = np.arange(len(shared))
    keep = column[code] >= 0
    which, code = which[keep], column[code[keep]]
    order = np.argsort(code, kind="stable")
    which, code = which[order], code[order]
    total = np.zeros((len(used), len(used)), np.float32)
    for c in range(0, len(shared), 4096):
        lo, hi = np.searchsorted(code, [c, c + 4096])
        m = np.zeros((len(used), min(4096, len(shared) - c)), np.float32)
        m[which[lo:hi], code[lo:hi] - c] = 1
        total += m @ m.T
    return total[u, v].astype(np.int64)


def _with_sets(docs: DataFrame, wanted: DataFrame, rows: int, width: int) -> DataFrame:
    """The shingle sets of the wanted sets (sk, doc_id), from their documents' texts."""
    names = wanted.select(F.col("doc_id").alias("_d"), F.col("sk").alias("_sk"))
    own = docs.select("doc_id", "text").join(small_side(names, rows), F.col("doc_id").eqNullSafe(F.col("_d")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.slices(batches, "text", 6 << 20):
            flat, offsets = shingles.shingle(batch.column("text"), width)
            keys, sets = [], []
            for want, a, b in zip(batch.column("_sk").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                own = np.unique(flat[a:b])
                if shingles.set_key(own) == want:  # a repeated doc_id may hold other texts
                    keys.append(want)
                    sets.append(own.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["sk", "set"])

    return own.select("_sk", "text").mapInArrow(run, "sk binary, set binary")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """One row per document row: doc_id, class_id, copy_id, n_links.

    Two documents are linked when the Jaccard similarity of their shingle sets is at
    least the threshold. class_id is the least doc_id of the documents linked to it
    directly or through others, copy_id that of its equals (equal shingle sets), and
    n_links the number of other documents linked to it directly, copies counted each.

    Null text is empty. Texts without words have the empty set and are copies of each
    other. Texts of fewer than ``width`` words have one shingle. Repeated rows are
    copies; a null doc_id stays null and is the class_id only of classes without any
    other id; further columns are ignored; no rows give no rows.
    """
    return _classes(docs, threshold, width).select("doc_id", "class_id", "copy_id", "n_links")


def _classes(docs: DataFrame, threshold: float, width: int) -> DataFrame:
    """``near_duplicates`` with the set key and the key of the class of every row."""
    signed = durable(signatures(docs, width), "signed")
    reps = signed.groupBy("sk").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("size").alias("size"))
    reps = durable(reps, "reps")
    entries = durable(bands(reps), "bands")
    stats = durable(entries.groupBy("band").agg(F.min("sk").alias("least"), F.count("*").alias("_n")).where("_n > 1").select("band", "least"), "buckets")
    shared = durable(entries.join(small_side(stats.select("band"), stats.count()), "band", "left_semi"), "shared")
    family = durable(components(_family_edges(shared, stats, reps, "stars"), "families").select(F.col("node").alias("sk"), F.col("root").alias("family")), "family")
    cross = durable(_cross_edges(durable(_cross_groups(shared, family), "groups"), reps, threshold).distinct(), "cross")
    group = durable(_merged(family, cross), "group")  # all candidates now lie inside a family
    sizes = group.groupBy("g").agg(F.count("*").alias("members"))
    wanted = durable(group.select("sk").distinct().join(reps, "sk").select("sk", "doc_id", "copies", "sig"), "wanted")
    sets = _with_sets(docs, wanted.select("sk", "doc_id"), wanted.count(), width).dropDuplicates(["sk"])
    members = _blocked(group, "g", sizes).join(wanted.select("sk", "copies", "sig"), "sk").join(sets, "sk")
    found = durable(_verify(members.select("g", "x", "y", "side", "sk", "copies", "sig", "set"), threshold), "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("sk")).agg(F.sum("n").alias("n"))
    root = components(found.where("b is not null").select("a", "b"), "classes").select(F.col("node").alias("sk"), "root")
    linked = counts.join(root, "sk", "full")
    least = reps.join(linked, "sk").groupBy("root").agg(F.min("doc_id").alias("class"))
    special = durable(linked.join(least, "root").select("sk", "n", "class", "root"), "linked")
    every = reps.select("sk", F.col("doc_id").alias("copy_id"), "copies").join(small_side(special, special.count()), "sk", "left")
    every = durable(every.select("sk", "copy_id", "copies", "n", "class", "root").where("copies > 1 or n is not null"), "classes")
    out = signed.select("doc_id", "sk").join(small_side(every, every.count()), "sk", "left")
    return out.select(
        "doc_id",
        "sk",
        F.coalesce("root", "sk").alias("class_key"),
        F.when(F.col("n").isNotNull(), F.col("class")).when(F.col("copies").isNotNull(), F.col("copy_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("copies").isNotNull(), F.col("copy_id")).otherwise(F.col("doc_id")).alias("copy_id"),
        (F.coalesce("n", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
    )


def keep_one(docs: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """The documents without all but one row of each class: that of the least doc_id
    (null ids last), of rows with one doc_id that of the least set. Columns of any name
    pass unchanged.

    A row is judged by its id and its text: where two texts share an id, or ids are
    null, one may go and the other stay. Repeated rows are copies; no rows, no rows.
    """
    found = durable(_classes(docs, threshold, width).select("doc_id", "sk", "class_key"), "near")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "sk")
    several = durable(found.groupBy("class_key").agg(F.min(first).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "several")
    lost = durable(found.join(small_side(several, several.count()), "class_key").where(~first.eqNullSafe(F.col("first"))).select("doc_id", "sk").distinct(), "lost")
    again = durable(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    n_again = again.count()
    gone = lost.where("doc_id is not null").select("doc_id").distinct()
    ids = F.broadcast(again) if n_again <= BROADCAST_ROWS else again
    once = docs.where("doc_id is not null").join(ids, "doc_id", "left_anti").join(small_side(gone, lost.count()), "doc_id", "left_anti").select(docs.columns)
    rest = docs.where("doc_id is null")
    if n_again:
        rest = rest.unionByName(docs.join(ids, "doc_id", "left_semi").select(docs.columns))
    elif rest.isEmpty():
        return once
    key = "_set"
    while key in docs.columns:
        key += "_"
    told = _keyed(rest, key, width).dropDuplicates(["doc_id", key])
    told = told.join(lost.select(F.col("doc_id").alias(key + "_d"), F.col("sk").alias(key + "_k")), F.col("doc_id").eqNullSafe(F.col(key + "_d")) & (F.col(key) == F.col(key + "_k")), "left_anti")
    return once.unionByName(told.select(docs.columns))


def _keyed(docs: DataFrame, key: str, width: int) -> DataFrame:
    """The rows with the key of their shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.slices(batches, "text", 6 << 20):
            flat, offsets = shingles.shingle(batch.column("text"), width)
            keys = [shingles.set_key(np.unique(flat[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, key])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(key, BinaryType())]))
