"""Fast exact tokenization of whole texts with the ``tokenizers`` library.

The byte-level pre-tokenizer always starts a new piece at a space or line feed
that follows a non-space character, so a text may be cut there, equal pieces may
be encoded once, and the ids put together again. Texts with any other white space,
two blanks in a row or the string of an added token are encoded as they are, a
stretch at a time. The result equals ``encode(text, add_special_tokens=False)`` of the
tokenizer as its file gives it, id for id; a text that spells an added token gets
that token's id, as in the plain call.

Batches are small and only the ids of an encoding are held, so memory follows the
batch and the longest text.
"""

from __future__ import annotations

import ctypes
import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 0
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_UNUSUAL = "[\\x00-\\x09\\x0b-\\x1f\\x7f-\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200f}\\x{2028}-\\x{202f}\\x{205f}\\x{3000}\\x{feff}]|[ \\n][ \\n]"
_BATCH_BYTES = 4 << 20
_JOIN = 512
_STRETCH = 1 << 18  # characters that the library encodes at a time
_SEAM = re.compile("[A-Za-z] ")
_LETTERS = "^[A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{ff}]+$"


def _byte_characters() -> dict[int, str]:
    """Byte to the character that stands for it in a byte-level vocabulary: printable
    bytes for themselves, the others from U+0100 on, in order."""
    out, n = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


_WIDE = {k: v for k, v in _byte_characters().items() if k > 126}


@functools.lru_cache(maxsize=2)
def load(path: str):
    """(tokenizer, the same one for words that are single pieces and come parted by
    blanks, whether an id begins with white space)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    t = Tokenizer.from_file(path)
    words = Tokenizer(t.model)  # shares the vocabulary
    for model in (t.model, words.model):
        if hasattr(model, "_resize_cache"):
            model._resize_cache(0)  # words come once each: looking them up costs more than it saves
    words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
    vocab = t.get_vocab(with_added_tokens=True)
    opens = np.zeros(max(vocab.values()) + 1, bool)
    for word, i in vocab.items():
        opens[i] = word[:1] in ("Ġ", "Ċ")
    return t, words, opens


@functools.lru_cache(maxsize=2)
def _untouched(path: str):
    """The tokenizer as its file gives it, for texts that are encoded as they are."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def _added(path: str) -> list[str]:
    """The strings that the tokenizer takes for added tokens."""
    return [x.content for x in load(path)[0].get_added_tokens_decoder().values()]


def _each(t, texts: list[str]) -> list[np.ndarray]:
    """The ids of every text; encodings are let go a stretch at a time."""
    out, start, size = [], 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size > _STRETCH or i + 1 == len(texts):
            out += [np.array(e.ids, np.uint32) for e in t.encode_batch_fast(texts[start : i + 1], add_special_tokens=False)]
            start, size = i + 1, 0
    return out


def _long(t, text: str) -> np.ndarray:
    """The ids of one text of any length, cut before blanks that follow a letter: a
    piece always ends there, and no added token holds a letter and then a blank."""
    parts, at = [], 0
    while len(text) - at > 2 * _STRETCH and (m := _SEAM.search(text, at + _STRETCH)):
        parts.append(text[at : m.end() - 1])
        at = m.end() - 1
    ids = [_each(t, [x])[0] for x in [*parts, text[at:]]]
    return ids[0] if len(ids) == 1 else np.concatenate(ids)


def _as_they_are(path: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat ids, begin and size of each) of texts with nothing before them."""
    ids = _each(load(path)[0], words.to_pylist())
    size = np.array([len(x) for x in ids], np.int64)
    return np.concatenate([np.zeros(0, np.uint32), *ids]), np.cumsum(size) - size, size


def _joined(t, opens: np.ndarray, words: pa.Array, glue: str, finish) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, ids per word) of words that each begin with white space once
    ``finish`` has prepared the texts in which ``glue`` joins them."""
    flat, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    cuts = np.append(np.arange(0, len(words), _JOIN), len(words)).astype(np.int32)
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), words), glue).to_pylist()
    for k, ids in enumerate(_each(t, [finish(x) for x in texts])):
        at = np.flatnonzero(opens[ids])
        if len(at) != cuts[k + 1] - cuts[k] or at[0] != 0:
            own = _each(t, [finish(x) for x in words[cuts[k] : cuts[k + 1]].to_pylist()])
            ids, n = np.concatenate(own), np.array([len(x) for x in own])
        else:
            n = np.diff(np.append(at, len(ids)))
        flat.append(ids)
        lengths.append(n)
    return np.concatenate(flat), np.concatenate(lengths).astype(np.int64)


def _spelt(text: str) -> str:
    """Words of accented letters, parted by blanks, in the letters of the vocabulary."""
    return "Ġ" + text.encode().decode("latin-1").translate(_WIDE).replace(" ", " Ġ")


def _pieces(path: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat ids, begin and size of each distinct piece). A leading line feed stands
    for itself, anything else follows one blank."""
    t, single, opens = load(path)
    letters = pc.match_substring_regex(words, _LETTERS).to_numpy(zero_copy_only=False)
    blank = pc.is_in(words, pa.array(["", "\n"])).to_numpy(zero_copy_only=False)
    begin, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    parts, used = [], 0
    # words of letters are one piece each: no pattern need part them again
    ascii_only = pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
    other = ~letters & ~blank
    rest = words.filter(pa.array(other))
    rest = pc.if_else(pc.starts_with(rest, "\n"), rest, pc.binary_join_element_wise("", rest, " "))
    plain, accented = words.filter(pa.array(letters & ascii_only)), words.filter(pa.array(letters & ~ascii_only))
    for mask, own, coder, glue, finish in ((letters & ascii_only, plain, single, " Ġ", "Ġ".__add__), (letters & ~ascii_only, accented, single, " ", _spelt), (other, rest, t, "", str)):
        ids, n = _joined(coder, opens, own, glue, finish)
        begin[mask], size[mask] = used + np.cumsum(n) - n, n
        parts.append(ids)
        used += len(ids)
    for i in np.flatnonzero(blank).tolist():
        ids = _each(t, [words[i].as_py() or " "])[0]
        begin[i], size[i] = used, len(ids)
        parts.append(ids)
        used += len(ids)
    return np.concatenate(parts), begin, size


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of flat[s : s + n]."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 2**31 else np.int64
    at = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return flat[at]


def _encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    n = len(texts)
    odd = pc.match_substring_regex(texts, _UNUSUAL).to_numpy(zero_copy_only=False)
    for string in _added(path):
        odd = odd | pc.match_substring(texts, string).to_numpy(zero_copy_only=False)
    plain = texts.filter(pa.array(~odd)) if odd.any() else texts
    split = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
    offsets = split.offsets.to_numpy().astype(np.int64)
    words = split.flatten().dictionary_encode()
    code = words.indices.to_numpy().astype(np.int64)
    # Marks after a letter or digit are a piece of their own: words differ less often.
    stems = pc.utf8_rtrim(words.dictionary, ".,;:!?")
    ends_well = pc.match_substring_regex(stems, r"[\pL\pN]$").to_numpy(zero_copy_only=False)
    marked = ends_well & (pc.binary_length(stems).to_numpy(zero_copy_only=False) < pc.binary_length(words.dictionary).to_numpy(zero_copy_only=False))
    stem = pc.if_else(pa.array(ends_well), stems, words.dictionary).dictionary_encode()
    flat, begin, sizes = _pieces(path, stem.dictionary)
    own = stem.indices.to_numpy()
    begin, sizes = begin[own], sizes[own]
    # marks and the first pieces of texts have no white space before them
    first = offsets[:-1]
    heads, back = np.unique(code[first], return_inverse=True)
    tails = pc.replace_substring_regex(words.dictionary.filter(pa.array(marked)), r"(?s)^.*[\pL\pN]", "").dictionary_encode()
    mark = np.full(len(words.dictionary), -1, np.int64)
    mark[marked] = tails.indices.to_numpy()
    alone, b_begin, b_size = _as_they_are(path, pa.concat_arrays([tails.dictionary, words.dictionary.take(pa.array(heads))]))
    used = len(flat)
    m_begin, m_size = b_begin[: len(tails.dictionary)] + used, b_size[: len(tails.dictionary)]
    at, size = begin[code], sizes[code]
    if len(first):
        at[first], size[first] = (b_begin[len(tails.dictionary) :] + used)[back], b_size[len(tails.dictionary) :][back]
    parts = [flat, alone]
    used += len(alone)
    # marks follow their words; the mark of a first piece is part of its own ids
    with_mark = mark[code] >= 0
    with_mark[first] = False
    after = np.flatnonzero(with_mark)
    if len(after):
        kind = mark[code[after]]
        at, size = np.insert(at, after + 1, m_begin[kind]), np.insert(size, after + 1, m_size[kind])
        offsets = offsets + np.append(0, np.cumsum(with_mark))[offsets]
        first = offsets[:-1]
    # each text ends with the end id
    parts.append(np.array([END_ID], np.uint32))
    ends = offsets[1:]
    at, size = np.insert(at, ends, used), np.insert(size, ends, 1)
    flat = _gather(np.concatenate(parts), at, size)
    totals = np.add.reduceat(size, first + np.arange(len(first))) if len(first) else np.zeros(0, np.int64)
    if not odd.any():
        return flat, totals
    whole = [_long(_untouched(path), x) for x in texts.filter(pa.array(odd)).to_pylist()]
    out, counts = [], np.zeros(n, np.int64)
    counts[~odd] = totals
    cut = np.append(0, np.cumsum(totals))
    k = j = 0
    for o in odd:
        if o:
            out.append(np.append(whole[j], np.uint32(END_ID)))
            j += 1
        else:
            out.append(flat[cut[k] : cut[k + 1]])
            k += 1
    counts[odd] = [len(x) + 1 for x in whole]
    return np.concatenate(out), counts


def give_back() -> None:
    """Return freed memory to the system: a worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = _BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text size (a single row may exceed it)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
        give_back()


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, ids per text) of texts, null as empty, each ended by END_ID."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return _encode(pc.fill_null(texts.cast(pa.string()), ""), path)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
