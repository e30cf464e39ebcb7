"""Best-fit packing of token sequences by exact-complement hashing.

Only the length histogram (at most ``capacity`` rows, whatever the corpus) goes to
the driver. The planner keeps a hash index from every sum to the single lengths, pairs
and triples that have it and, from the longest length down, looks up the complement of
what is placed and consumes combinations that fill it exactly, as often as the counts
allow; what is left is packed best-fit decreasing. The plan maps (length, rank) ranges to (sequence, offset); rows get
their rank within a length by a two-level count over hashed buckets, so a length
that holds a third of all rows is still dealt over every bucket.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm import tokens
from newsloom.llm.common import durable

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole below capacity, else full
    pieces after a first one that takes the remainder."""
    if total <= capacity:
        return [(0, total)]
    head = total % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, total, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, with_ids: bool = False) -> DataFrame:
    """The token pieces of every document (null text: empty, so one end id)."""
    schema = PIECES + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.slices(batches, "text"):
            flat, counts = tokens.encode(batch.column("text"), tokenizer)
            doc_ids = batch.column("doc_id").to_pylist()
            rows, at = [], 0
            for doc_id, n in zip(doc_ids, counts.tolist(), strict=True):
                for k, (start, length) in enumerate(cut(n, capacity)):
                    ids = flat[at + start : at + start + length]
                    rows.append((doc_id, k, start, length, tokens.crc(ids), *([ids.astype("<u4").tobytes()] if with_ids else [])))
                at += n
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * (5 + with_ids)
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Sums:
    """Hash index from a sum to the single lengths, pairs and triples of lengths that
    have it, under the counts that are left.

    Pairs are indexed at once: every sum has its list of larger halves. The triples of a
    sum are the lengths whose complement has pairs; that list is made when the sum is
    first asked for. Counts only fall, so an entry that is used up is dropped for good.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        capacity = len(left) - 1
        self.lengths = np.flatnonzero(left)
        pairs: dict[int, list[np.ndarray]] = {}
        for small in self.lengths:  # at most ``capacity`` lengths; a pair may use one twice
            large = self.lengths[(self.lengths >= small) & (self.lengths <= capacity - small)]
            for total, b in zip((large + small).tolist(), large.tolist()):
                pairs.setdefault(total, []).append(b)
        for halves in pairs.values():
            halves.sort(reverse=True)  # the evenest pair is taken first, from the end
        self.pairs = pairs
        self.triples: dict[int, list[int]] = {}

    def single(self, total: int) -> tuple[int, ...] | None:
        return (total,) if total > 0 and self.left[total] else None

    def pair(self, total: int, keep: int = 0) -> tuple[int, ...] | None:
        """``keep``: a length of which one must stay for the caller."""
        halves = self.pairs.get(total, [])
        while halves:
            b = halves[-1]
            c = total - b
            if self.left[b] and self.left[c] and (b != c or self.left[b] > 1):
                break
            halves.pop()
        for b in reversed(halves):
            c = total - b
            need = (b == keep) + (c == keep) + 1 if keep else 0
            if self.left[b] and self.left[c] and (b != c or self.left[b] > 1) and (not keep or self.left[keep] >= need):
                return (b, c)
        return None

    def triple(self, total: int) -> tuple[int, ...] | None:
        if total not in self.triples:
            self.triples[total] = [d for d in self.lengths.tolist() if self.pairs.get(total - d)]
        firsts = self.triples[total]
        while firsts:
            d = firsts[-1]
            if self.left[d] and (p := self.pair(total - d, d)):
                return (d, *p)
            firsts.pop()
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths summing to at most capacity, longest first) and how many
    sequences follow each; together they use every count exactly."""
    if any(n and not 0 < length <= capacity for length, n in counts.items()):
        raise ValueError("a length lies outside 1..capacity")
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []
    sums = Sums(left)

    def use(pattern: tuple[int, ...]) -> bool:
        need = {x: pattern.count(x) for x in pattern}
        times = min(int(left[x]) // k for x, k in need.items())
        if times:
            for x, k in need.items():
                left[x] -= times * k
            out.append((pattern, times))
        return times > 0

    if left[capacity]:
        use((capacity,))
    for a in range(capacity - 1, 0, -1):
        for find in (sums.single, sums.pair, sums.triple):
            while left[a] and (found := find(capacity - a)) and use((a, *found)):
                pass
    # Best-fit decreasing over the rest, many equal sequences at a time.
    open_by_gap: dict[int, list[list]] = {}
    gaps: list[int] = []

    def put(gap: int, pattern: tuple[int, ...], times: int) -> None:
        if times:
            if gap not in open_by_gap:
                insort(gaps, gap)
                open_by_gap[gap] = []
            open_by_gap[gap].append([pattern, times])

    for a in range(capacity, 0, -1):
        n = int(left[a])
        while n:
            i = bisect_left(gaps, a)
            if i < len(gaps):
                gap = gaps[i]
                pattern, times = open_by_gap[gap].pop()
                if not open_by_gap[gap]:
                    del open_by_gap[gap], gaps[i]
                used = min(n, times)
                put(gap, pattern, times - used)
                put(gap - a, (*pattern, a), used)
            else:
                # as many of the same length as fit together, then the remainder
                k = min(n, capacity // a)
                used = n // k
                put(capacity - k * a, (a,) * k, used)
                used *= k
            n -= used
    out += [(pattern, times) for group in open_by_gap.values() for pattern, times in group]
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, items a sequence, offset):
    the item of rank r goes to sequence first + (r - first rank) // items, at
    offset + ((r - first rank) % items) * length."""
    seen: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, times in patterns:
        at, i = 0, 0
        while i < len(pattern):
            a = pattern[i]
            k = 1
            while i + k < len(pattern) and pattern[i + k] == a:
                k += 1
            first = seen.get(a, 0)
            out.append((a, first, first + times * k - 1, sequence, k, at))
            seen[a] = first + times * k
            at += a * k
            i += k
        sequence += times
    return out


def pack(items: DataFrame, capacity: int, keys: list[str]) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` in 1..capacity.

    ``keys`` order and deal the rows; repeated or null keys are fine, each row is
    placed once. No rows give no rows. Rows of one length are interchangeable, so
    ties need no rule for the packing itself. ``items`` is read twice and should
    be a written table.
    """
    spark = items.sparkSession
    sizes = {r[0]: r[1] for r in items.groupBy("length").count().collect()}  # at most ``capacity`` rows
    total = sum(sizes.values())
    buckets = max(1, math.isqrt(total))  # rows of a bucket and buckets of a length grow alike
    places = slots(plan(sizes, capacity))
    dealt = items.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    per = dealt.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    ranked = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_b").orderBy(*keys)) - 1)
    ranked = ranked.join(base, ["length", "_b"]).withColumn("_rank", F.col("_base") + F.col("_r"))
    place = spark.createDataFrame(places, "length bigint, _lo bigint, _hi bigint, _seq bigint, _k bigint, _at bigint")
    # Ranges of one length are contiguous from 0: an array of them per length and a
    # binary choice by the last start at or below the rank.
    by_length = place.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("_lo", "_seq", "_k", "_at"))).alias("_p"))
    out = ranked.join(F.broadcast(by_length), "length")  # at most ``capacity`` lengths and some thousand ranges
    slot = F.element_at(F.filter("_p", lambda p: p["_lo"] <= F.col("_rank")), -1)
    out = out.withColumn("_s", slot).withColumn("_d", F.col("_rank") - F.col("_s._lo"))
    return out.select(
        *[F.col(c) for c in items.columns],
        F.expr("_s._seq + _d div _s._k").cast("bigint").alias("sequence_id"),
        (F.col("_s._at") + F.pmod(F.col("_d"), F.col("_s._k")) * F.col("length")).cast("bigint").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Packs all documents: one row per piece with its place.

    Null text counts as empty (one end id). Repeated rows are packed once each,
    a null doc_id like any other; columns besides doc_id and text are ignored, an
    empty table gives no rows, long texts are cut and never shortened.
    """
    return pack(durable(pieces(docs, tokenizer, capacity), "pieces"), capacity, ["doc_id", "piece", "start", "ids_crc32"])
