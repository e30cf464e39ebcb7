"""Word shingles and MinHash signatures of whole texts, computed a batch at a time.

Words are maximal runs of letters, digits and underscores of the lower-cased text;
a shingle is ``width`` consecutive words (all of them, if a text has fewer). Words
are hashed once per batch with 64-bit XXH3 and combined to 64-bit shingle hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _factors(n: int) -> np.ndarray:
    out = [int(x) for x in _MIX]
    while len(out) < n:
        out.append((out[-1] * 6364136223846793005 + 1442695040888963407) % 2**64 | 1)
    return np.array(out[:n], np.uint64)


def _finish(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(word codes, offsets of each text, the distinct words); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))
    # a space on either side keeps texts without words apart from texts with one
    clean = pc.replace_substring_regex(low, r"[^\pL\pN_]+", " ")
    split = pc.split_pattern(pc.ascii_trim(clean, " "), " ")
    offsets = split.offsets.to_numpy().astype(np.int64)
    coded = split.flatten().dictionary_encode()
    code, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
    if "" in known:  # texts without words hold one empty string
        blank = known.index("")
        drop = code == blank
        offsets = offsets - np.append(0, np.cumsum(drop))[offsets]
        code = code[~drop]
    return code, offsets - offsets[0], known


def shingle(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, offsets of each text): in order of place, repeats kept."""
    code, offsets, known = words(texts)
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in known] or [0], np.uint64)
    h = own[code]
    n = np.diff(offsets)
    factors = _factors(width)
    padded = np.append(h, np.zeros(width, np.uint64))
    rolled = np.zeros(len(h), np.uint64)
    for k in range(width):
        rolled += padded[k : k + len(h)] * factors[k]
    rolled = _finish(rolled)
    sizes = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    for short in range(1, width):  # the length is mixed in, so they differ from any prefix
        at = offsets[:-1][n == short]
        x = np.full(len(at), short, np.uint64)
        for k in range(short):
            x = x * factors[0] + padded[at + k] * factors[k]
        rolled[at] = _finish(x)
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    at = np.repeat(offsets[:-1] - (ends - sizes), sizes) + np.arange(total)
    return rolled[at], np.append(0, ends)


def hash_factors(n: int, seed: int = 1) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least value of each hash over a text's shingles, as its low 32 bits."""
    out = np.full(len(factors), 2**64 - 1, np.uint64)
    for a in range(0, len(shingles), 1024):  # blocks that stay in the cache
        out = np.minimum(out, (shingles[a : a + 1024, None] * factors).min(axis=0))
    return (out >> np.uint64(32)).astype(np.uint32)


def set_key(distinct: np.ndarray) -> bytes:
    """A 128-bit name of a shingle set, given sorted and distinct."""
    return hashlib.blake2b(distinct.astype("<u8").tobytes(), digest_size=16).digest()
