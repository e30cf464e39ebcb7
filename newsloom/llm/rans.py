"""Token-id files coded with a static range asymmetric numeral system.

One frequency table, counted over the whole corpus, serves every file. A file is a
sequence of segment images; each image holds whole documents and codes their ids in
independent blocks of ``BLOCK`` ids, every block with ``LANES`` interleaved coder
states. The image's checkpoint table gives each block's first word and its states,
so blocks decode on their own and in any order, and a CRC-32 of its ids proves it.

Image, little-endian: magic ``NLRANS1\\0``; u32 documents, u64 ids, u32 blocks;
i64 document ids (the least value stands for null), u32 id counts; per block u32
words, u32 CRC-32, LANES x u64 states; then all words (u32). Files are Parquet
containers of images, one row (shard, segment, start, image) each, so any store that
Spark writes can hold them and a lost task writes its rows again.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm import tokens
from newsloom.llm.common import durable, scratch_path, small_side

BITS = 20
LANES = 32
BLOCK = 16_384
SEGMENT = 1 << 20
MAGIC = b"NLRANS1\0"
NULL_ID = -(2**63)
_LOW = np.uint64(1 << 31)
_STACK = 64  # blocks coded side by side


class Table:
    """Frequencies scaled to 2**BITS; every counted symbol keeps at least one slot."""

    def __init__(self, counts: np.ndarray):
        total, size = int(counts.sum()), 1 << BITS
        seen = np.flatnonzero(counts)
        if len(seen) > size:
            raise ValueError("more symbols than slots")
        freq = np.zeros(len(counts), np.int64)
        freq[seen] = np.maximum(1, (counts[seen].astype(np.float64) * size / max(total, 1)).astype(np.int64))
        over = int(freq.sum()) - size
        if len(seen):
            order = seen[np.argsort(-freq[seen], kind="stable")]
            for s in order:  # the largest give or take the rounding
                step = min(over, int(freq[s]) - 1) if over > 0 else over
                freq[s] -= step
                over -= step
                if not over:
                    break
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq)), freq).astype(np.uint32)
        self.filler = int(np.argmax(freq)) if len(seen) else 0

    def encode(self, ids: np.ndarray) -> bytes:
        """Blocks of ids as checkpoint table and words."""
        n = len(ids)
        blocks = -(-n // BLOCK)
        heads, streams = [], []
        for b in range(0, blocks, _STACK):
            own = ids[b * BLOCK : (b + _STACK) * BLOCK]
            k = -(-len(own) // BLOCK)
            filled = np.full(k * BLOCK, self.filler, np.int64)
            filled[: len(own)] = own
            steps = filled.reshape(k, BLOCK // LANES, LANES).transpose(1, 0, 2).reshape(BLOCK // LANES, k * LANES)
            words = np.empty(steps.shape, np.uint32)
            emits = np.empty(steps.shape, bool)
            x = np.full(k * LANES, _LOW, np.uint64)
            for t in range(len(steps) - 1, -1, -1):
                f = self.freq[steps[t]]
                full = x >= (f << np.uint64(63 - BITS))
                words[t] = x
                emits[t] = full
                x = np.where(full, x >> np.uint64(32), x)
                q = x // f
                x = (q << np.uint64(BITS)) + (x - q * f) + self.start[steps[t]]
            emits = emits.reshape(-1, k, LANES).transpose(1, 0, 2)
            words = words.reshape(-1, k, LANES).transpose(1, 0, 2)
            states = x.reshape(k, LANES)
            for j in range(k):
                stream = words[j][emits[j]].astype("<u4")
                check = zlib.crc32(own[j * BLOCK : (j + 1) * BLOCK].astype("<u4").tobytes())
                heads.append(struct.pack("<II", len(stream), check) + states[j].astype("<u8").tobytes())
                streams.append(stream.tobytes())
        return b"".join(heads + streams)

    def decode(self, data: bytes, n: int, only: range | None = None) -> np.ndarray:
        """The ids; ``only`` decodes that range of blocks from their checkpoints."""
        blocks = -(-n // BLOCK)
        kind = np.dtype([("words", "<u4"), ("crc", "<u4"), ("states", "<u8", (LANES,))])
        heads = np.frombuffer(data, kind, blocks)
        stream = np.frombuffer(data, "<u4", offset=blocks * kind.itemsize)
        ends = np.cumsum(heads["words"].astype(np.int64))
        if blocks and ends[-1] != len(stream):
            raise ValueError("the words do not match the checkpoint table")
        stream = np.append(stream, np.uint32(0)).astype(np.uint64)
        out = []
        todo = only if only is not None else range(blocks)
        mask = np.uint64((1 << BITS) - 1)
        for b in range(todo.start, todo.stop, _STACK):
            own = slice(b, min(b + _STACK, todo.stop))
            x = heads["states"][own].astype(np.uint64)
            k = len(x)
            at = (ends - heads["words"])[own]
            got = np.empty((BLOCK // LANES, k, LANES), np.uint32)
            for t in range(len(got)):
                slot = x & mask
                s = self.symbol[slot]
                got[t] = s
                x = self.freq[s] * (x >> np.uint64(BITS)) + slot - self.start[s]
                need = x < _LOW
                rank = np.cumsum(need, axis=1)
                word = stream[np.minimum(at[:, None] + rank - 1, len(stream) - 1)]
                x = np.where(need, (x << np.uint64(32)) | word, x)
                at = at + rank[:, -1]
            flat = got.transpose(1, 0, 2).reshape(k, BLOCK)
            for j in range(k):
                ids = flat[j][: min(BLOCK, n - (b + j) * BLOCK)]
                if zlib.crc32(ids.astype("<u4").tobytes()) != heads["crc"][b + j]:
                    raise ValueError(f"block {b + j}: checksum does not match")
                out.append(ids)
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def write_image(table: Table, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    head = struct.pack("<8sIQI", MAGIC, len(doc_ids), len(ids), -(-len(ids) // BLOCK))
    return head + doc_ids.astype("<i8").tobytes() + counts.astype("<u4").tobytes() + table.encode(ids)


def read_image(table: Table, image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    magic, docs, n, _ = struct.unpack_from("<8sIQI", image)
    if magic != MAGIC:
        raise ValueError("not a segment image")
    at = struct.calcsize("<8sIQI")
    doc_ids = np.frombuffer(image, "<i8", docs, at)
    counts = np.frombuffer(image, "<u4", docs, at + 8 * docs)
    return doc_ids, counts, table.decode(image[at + 12 * docs :], n)


def _squeeze(ids: np.ndarray) -> bytes:
    """Byte planes under zstd: for shuffles and scratch tables only."""
    wide = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    planes = np.empty((wide, len(ids)), np.uint8)
    for k in range(wide):
        planes[k] = ids >> (8 * k)
    return bytes([wide]) + zstandard.ZstdCompressor(level=1).compress(planes)


def _unsqueeze(data: bytes) -> np.ndarray:
    wide = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(memoryview(data)[1:]), np.uint8).reshape(wide, -1)
    out = planes[0].astype(np.uint32)
    for k in range(1, wide):
        out |= planes[k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _shards(docs: DataFrame) -> np.ndarray:
    """Upper bounds of doc_id ranges of about equal row counts, two for each input
    split, so that a shard is of the order of a split at every size of the table; eight
    bytes each on the driver. A doc_id that fills whole ranges ends several of them."""
    splits = docs.select(F.spark_partition_id().alias("k")).agg(F.max("k")).first()[0]
    if splits is None:
        return np.zeros(0, np.int64)
    # the second key parts a doc_id that many rows share
    dealt = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).repartitionByRange(2 * (splits + 1), "doc_id", F.rand(7))
    found = dealt.groupBy(F.spark_partition_id().alias("k")).agg(F.max("doc_id").alias("last")).collect()
    return np.array(sorted(r["last"] for r in found if r["last"] is not None)[:-1], np.int64)


def _segments(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Tokenized whole documents in ascending doc_id order: (shard, segment, doc_ids,
    counts, ids) rows of about SEGMENT ids."""
    bounds = _shards(docs)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.slices(batches, "text", 8 << 20):
            flat, counts = tokens.encode(batch.column("text"), tokenizer)
            doc_ids = batch.column("doc_id").cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(bounds, doc_ids, "left"), np.searchsorted(bounds, doc_ids, "right")
            # a doc_id that fills whole shards is dealt over them
            shard = low + np.arange(len(doc_ids)) % (high - low + 1)
            order = np.argsort(shard, kind="stable")
            begin = np.cumsum(counts) - counts
            rows = []
            for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
                ids = tokens._gather(flat, begin[own], counts[own])
                rows.append((int(shard[own[0]]), doc_ids[own].astype("<i8").tobytes(), counts[own].astype("<u4").tobytes(), _squeeze(ids)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int32()] + [pa.binary()] * 3)], names=["shard", "doc_ids", "counts", "ids"])

    def merge(group: pa.Table) -> pa.Table:
        doc_ids = np.concatenate([np.frombuffer(x, "<i8") for x in group["doc_ids"].to_pylist()])
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in group["counts"].to_pylist()]).astype(np.int64)
        ids = np.concatenate([_unsqueeze(x) for x in group["ids"].to_pylist()])
        begin = np.cumsum(counts) - counts
        order = np.lexsort((counts, doc_ids))
        cut = np.cumsum(counts[order]) // SEGMENT
        rows = []
        for k, own in enumerate(np.split(order, np.flatnonzero(np.diff(cut)) + 1)):
            rows.append((group["shard"][0].as_py(), k, int(counts[own].sum()), doc_ids[own].astype("<i8").tobytes(), counts[own].astype("<u4").tobytes(), _squeeze(tokens._gather(ids, begin[own], counts[own]))))
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["shard", "segment", "n", "doc_ids", "counts", "ids"])

    dealt = docs.select("doc_id", "text").mapInArrow(chunks, "shard int, doc_ids binary, counts binary, ids binary")
    return dealt.groupBy("shard").applyInArrow(merge, "shard int, segment int, n bigint, doc_ids binary, counts binary, ids binary")


def _counts(segments: DataFrame, vocabulary: int) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for data in batch.column("ids").to_pylist():
                total += np.bincount(_unsqueeze(data), minlength=vocabulary)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    out = np.zeros(vocabulary, np.int64)
    summed = segments.select("ids").mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n"))
    for i, n in summed.collect():  # at most one row for each id of the vocabulary
        out[i] = n
    return out


def write_files(docs: DataFrame, tokenizer: str, path: str) -> Table:
    """Encodes all documents into ``path``/images, in ascending doc_id order, with the
    frequency table in ``path``/table; returns that table."""
    spark = docs.sparkSession
    segments = durable(_segments(docs, tokenizer), "segments")
    vocabulary = len(tokens.load(tokenizer)[-1])
    counts = _counts(segments, vocabulary)
    table = Table(counts)
    # Starts: running sums over shards (two for each input split) and, inside a shard,
    # over its segments.
    shard = segments.groupBy("shard").agg(F.sum("n").alias("m"))
    base = shard.select("shard", F.coalesce(F.sum("m").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = segments.select("shard", "segment", "n").withColumn("inner", inner).join(base, "shard")
    starts = durable(starts.select("shard", "segment", (F.col("base") + F.col("inner")).alias("start")), "starts")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                image = write_image(table, np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["counts"], "<u4"), _unsqueeze(row["ids"]))
                yield pa.RecordBatch.from_pylist([{"shard": row["shard"], "segment": row["segment"], "start": row["start"], "image": image}], pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("start", pa.int64()), ("image", pa.binary())]))

    placed = segments.join(small_side(starts, starts.count()), ["shard", "segment"])
    coded = placed.select("shard", "segment", "start", "doc_ids", "counts", "ids").mapInArrow(code, "shard int, segment int, start bigint, image binary")
    coded.write.option("compression", "uncompressed").parquet(f"{path}/images")
    spark.createDataFrame([(i, int(n)) for i, n in enumerate(counts) if n], "id int, n bigint").coalesce(1).write.parquet(f"{path}/table")
    return table


def load_table(spark, path: str) -> Table:
    rows = spark.read.parquet(f"{path}/table").collect()  # at most one row for each id of the vocabulary
    counts = np.zeros(1 + max((r[0] for r in rows), default=0), np.int64)
    for i, n in rows:
        counts[i] = n
    return Table(counts)


def read_files(spark, path: str, with_ids: bool = False) -> DataFrame:
    """Decodes the files: doc_id, start, n_tokens, ids_crc32 (and the ids)."""
    table = load_table(spark, path)
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, image in zip(batch.column("start").to_pylist(), batch.column("image").to_pylist()):
                doc_ids, counts, ids = read_image(table, image)
                ends = np.cumsum(counts.astype(np.int64))
                raw = ids.astype("<u4").tobytes()
                parts = [raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
                cols = [pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(start + ends - counts), pa.array(counts.astype(np.int64)), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(parts, pa.binary())] if with_ids else []), names=[x.split()[0] for x in schema.split(", ")])

    return spark.read.parquet(f"{path}/images").select("start", "image").mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes every document's ids to files and reads them back.

    Null text counts as empty (one end id). Null doc_ids come first; repeated doc_ids
    keep a row each, in any order; other columns are ignored; an empty table
    writes empty files and gives no rows. Whole texts of any length are coded.
    """
    path = scratch_path(docs.sparkSession, "rans")
    write_files(docs, tokenizer, path)
    return read_files(docs.sparkSession, path)
