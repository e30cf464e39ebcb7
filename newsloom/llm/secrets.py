"""Secret scans with structural confirmation.

Three base patterns find candidates; the confirmation step decodes base64 or hex
runs and reports those whose bytes really are a key or token: DER key structures
(every nested length checked), length-prefixed SSH keys, signed web tokens (header
must be JSON that names an algorithm), and PEM armour whose body decodes to one.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from newsloom.llm import tokens

Span = tuple[str, int, int]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "jwt", "der", "ssh", "pem", "hexder")
_ORDER = {k: i for i, k in enumerate(KINDS)}

# a JSON object starts with "{" or white space, which base64 begins with "ey", "ew", "I", "C" or "D"
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(?:e[yw]|[ICD][A-Za-z0-9_-])[A-Za-z0-9_-]{9,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
# DER sequences start with byte 0x30 ("M" in base64), SSH blobs with a 4-byte
# length below 256 and "ssh-" or "ecdsa-" ("AAAA")
_B64 = re.compile(r"(?<![A-Za-z0-9+/])(?:M[A-Za-z0-9+/]{23,}|AAAA[A-Za-z0-9+/]{28,})={0,2}")
# the same and "openssh-key" ("b3Bl") in the URL-safe alphabet or over several lines
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])(?:M|AAAA|b3Bl)[A-Za-z0-9+/_-]{15,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)*={0,2}")
_WRAPPED_HEX = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{14,}(?:\r?\n[ \t]*[0-9A-Fa-f]+)*")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----((?:\s*[A-Za-z][A-Za-z0-9-]*:[^\n]*\n)*)([A-Za-z0-9+/=\s]{16,}?)-----END \1-----")
_ANY_RE2 = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{14}|[0-9a-f]{16}|30[0-9A-Fa-f]{14}|(?:e[yw]|[ICD][A-Za-z0-9_-])[A-Za-z0-9_-]{9,}\.[A-Za-z0-9_-]{2}|(?:M|AAAA|b3Bl)[A-Za-z0-9+/_-]{15}|-----BEGIN"
_ANY = re.compile(_ANY_RE2, re.A)


def _der_length(data: bytes, at: int) -> tuple[int, int] | None:
    if at >= len(data):
        return None
    n = data[at]
    if n < 0x80:
        return n, at + 1
    k = n & 0x7F
    if not 1 <= k <= 4 or at + 1 + k > len(data) or data[at + 1] == 0:
        return None
    return int.from_bytes(data[at + 1 : at + 1 + k], "big"), at + 1 + k


def der_tree(data: bytes, depth: int = 0) -> list | None:
    """The nested (tag, value) list of DER bytes, or None when any length is off."""
    out, at = [], 0
    while at < len(data):
        tag = data[at]
        if tag == 0 or tag & 0x1F == 0x1F or (size := _der_length(data, at + 1)) is None:
            return None
        n, body = size
        if body + n > len(data):
            return None
        value = data[body : body + n]
        if tag & 0x20:
            value = der_tree(value, depth + 1) if depth < 16 else None
            if value is None:
                return None
        out.append((tag, value))
        at = body + n
    return out


def is_der_key(data: bytes) -> bool:
    """A single SEQUENCE, all lengths nested exactly, that holds an integer version
    and key integers (private key), an algorithm identifier and a bit or octet
    string (public or wrapped key), or an octet string scalar (curve key)."""
    if len(data) < 16 or data[0] != 0x30:
        return False
    tree = der_tree(data)
    if not tree or len(tree) != 1 or not tree[0][1]:
        return False
    tags = [t for t, _ in tree[0][1]]
    integers = [v for t, v in tree[0][1] if t == 2]
    algorithm = any(t == 0x30 and v and v[0][0] == 6 for t, v in tree[0][1])
    return (
        (len(integers) == len(tags) >= 2 and max(map(len, integers)) >= 16)  # version or modulus, then numbers
        or (algorithm and (3 in tags or 4 in tags))
        or (tags[:2] == [2, 4] and len(integers[0]) == 1)
    )


def is_ssh_key(data: bytes) -> bool:
    """Length-prefixed fields to the end, the first naming a key type."""
    fields, at = [], 0
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return at == len(data) and len(fields) >= 2 and re.match(rb"(ssh-|ecdsa-|sk-)[a-z0-9@.-]+$", fields[0]) is not None


def is_openssh_key(data: bytes) -> bool:
    """openssh-key-v1: cipher, kdf, its options, the public keys and the private
    block as length-prefixed fields to the end."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    fields, at, left = [], len(magic), 3
    while left:
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + n])
        at, left = at + 4 + n, left - 1
        if len(fields) == 3:
            keys = int.from_bytes(data[at : at + 4], "big")
            if not 1 <= keys <= 64:
                return False
            at, left = at + 4, keys + 1
    return at == len(data) and len(fields[0]) > 0 and all(map(is_ssh_key, fields[3:-1])) and len(fields[-1]) >= 8


def _unbase64(text: str) -> bytes | None:
    body = re.sub(r"\s+", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(text: str) -> bool:
    """Three parts; the first decodes to a JSON object that names an algorithm, the
    second to bytes, and the signature is there unless the algorithm is none."""
    head, _, rest = text.partition(".")
    payload, _, signature = rest.partition(".")
    raw = _unbase64(head)
    try:
        header = json.loads(raw) if raw else None
    except (ValueError, RecursionError):  # UnicodeDecodeError is a ValueError
        return False
    if not isinstance(header, dict) or not isinstance(header.get("alg"), str) or _unbase64(payload) is None:
        return False
    return header["alg"].lower() == "none" or bool(_unbase64(signature))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each base kind; the span is the match."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def _line_ends(run: str, unit: int) -> Iterator[tuple[str, int]]:
    """The run without line breaks up to the ends of its lines, with their places. A
    DER run stops at the line that reaches the length its head states; ``unit`` is 3 for
    base64 and 1 for hex."""
    decode, size = (_unbase64, 4 / 3) if unit == 3 else (bytes.fromhex, 2)
    der, got, need = run[0] in "M3", "", 0
    if not der and not re.match(rb"\0\0\0.(ssh-|ecdsa|sk-)|openssh-k", _unbase64(run[:12]) or b"", re.S):
        return
    for m in re.finditer(r"\S+", run):
        got += m[0]
        if der and not need:
            head = _der_length(decode(got[:12]) or b"", 1)
            if head is None:
                return
            need = sum(head) * size
        if len(got.rstrip("=")) >= need:
            yield got, m.end()
            if der:
                return


def _wrapped_spans(text: str) -> Iterator[Span]:
    """Keys in either base64 alphabet or hex of either case, also over several lines."""
    for pattern, unit in ((_WRAPPED, 3), (_WRAPPED_HEX, 1)):
        at = 0
        while m := pattern.search(text, at):
            at = m.start() + len(m[0].split("\n", 1)[0])  # a later line can start a key as well
            for body, end in _line_ends(m[0], unit):
                data = _unbase64(body) if unit == 3 else bytes.fromhex(body) if len(body) % 2 == 0 else None
                kind = data and ("der" if is_der_key(data) else "ssh" if is_ssh_key(data) or is_openssh_key(data) else None)
                if kind:
                    at = m.start() + end
                    yield kind if unit == 3 else "hexder", m.start(), at
                    break


def confirmed_spans(text: str) -> list[Span]:
    """Candidates whose decoded structure proves a key or signed token."""
    out = [("jwt", *m.span()) for m in _JWT.finditer(text) if is_signed_token(m[0])]
    for m in _B64.finditer(text):
        data = _unbase64(m[0])
        if data and is_der_key(data):
            out.append(("der", *m.span()))
        elif data and is_ssh_key(data):
            out.append(("ssh", *m.span()))
    if "-----BEGIN" in text:
        for m in _PEM.finditer(text):
            data = _unbase64(m[3])
            # an encrypted body, which its header lines state, has no structure to parse
            if data and (is_der_key(data) or is_openssh_key(data) or "ENCRYPTED" in m[2]):
                out.append(("pem", *m.span()))
    for m in HEX.finditer(text):
        if len(m[0]) >= 32 and len(m[0]) % 2 == 0 and m[0].startswith("30") and is_der_key(bytes.fromhex(m[0])):
            out.append(("hexder", *m.span()))
    known = {x[:2] for x in out}
    return out + [x for x in _wrapped_spans(text) if x[:2] not in known]


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start, then kind as listed."""
    if _ANY.search(text) is None:
        return [], []
    base = sorted(base_spans(text), key=lambda s: (s[1], _ORDER[s[0]], s[2]))
    return base, sorted(base + confirmed_spans(text), key=lambda s: (s[1], _ORDER[s[0]], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """Spans (merged where they touch) become ``[secret]``."""
    out, at = [], 0
    for _, a, b in spans:
        if a > at or not out:
            out += [text[at:a], "[secret]"]
        elif a == at:
            pass
        at = max(at, b)
    return "".join(out) + text[at:]


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, counts of base kinds, digest of the base
    spans, and all spans as text.

    Positions are code points, ends exclusive. Null text is empty and has no span;
    null or repeated doc_ids are reported as they come; other columns are ignored;
    no rows give no rows. Whole texts are scanned; no shuffle.
    """
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for batch in tokens.slices(batches, "text"):
            n = batch.num_rows
            counts = {k: [0] * n for k in KINDS[:3]}
            digests, listed = [empty] * n, [""] * n
            for i, text in _suspects(batch.column("text")):
                base, every = scan(text)
                for kind, _, _ in base:
                    counts[kind][i] += 1
                digests[i], listed[i] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(counts[k], pa.int64()) for k in KINDS[:3]), pa.array(digests, pa.string()), pa.array(listed, pa.string())],
                names=[x.split()[0] for x in schema.split(", ")],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _suspects(texts: pa.Array) -> Iterator[tuple[int, str]]:
    """Texts in which any pattern can match at all."""
    hit = pc.fill_null(pc.match_substring_regex(texts, _ANY_RE2), False)
    at = pc.indices_nonzero(hit)
    yield from zip(at.to_pylist(), texts.take(at).to_pylist(), strict=True)


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced; n_chars follows the new text. All
    rows and columns stay; null texts stay null."""
    names = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.slices(batches, "text"):
            found = {}
            for i, text in _suspects(batch.column("text")):
                _, every = scan(text)
                if every:
                    found[i] = redact(text, every)
            if found:
                texts = batch.column("text").to_pylist()
                for i, text in found.items():
                    texts[i] = text
                cols = {c: batch.column(c) for c in names}
                cols["text"] = pa.array(texts, cols["text"].type)
                if "n_chars" in cols:
                    n = cols["n_chars"].to_pylist()
                    for i, text in found.items():
                        n[i] = len(text)
                    cols["n_chars"] = pa.array(n, cols["n_chars"].type)
                batch = pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)
            yield batch

    return docs.mapInArrow(run, schema)
