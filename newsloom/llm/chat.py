"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Turn
spans are found without knowing how it works: successive prefixes of the turns are
rendered, and what prefix k adds to prefix k - 1 is the span of turn k. A template
that changes what it rendered before (trims old turns, moves a system prompt) is
detected because the older output is no longer a prefix; the operator then reports
the turn and the first changed position instead of a wrong span.

The loss mask is found in the same way: an assistant turn is rendered once more with
each of two short probe texts; where these two outputs begin and cease to differ, the
template puts the text. The mask covers exactly that stretch of the real output.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

END = "</turn>"
_NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
_BACK = {v: k for k, v in _NAMES.items()}
_HEAD = re.compile(r"### ([^:\\]*(?:\\.[^:\\]*)*): ", re.S)


def escape(text: str) -> str:
    """Reversible: the backslash first, then the strings that mark turns."""
    return text.replace("\\", "\\\\").replace("###", "\\###").replace(END, "\\" + END)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|###|</turn>)", r"\1", text)


def _label(role: str) -> str:
    # any other role is written as it is, after "=", with its own escapes
    return _NAMES.get(role) or "=" + role.replace("\\", "\\\\").replace(":", "\\:")


def _role(label: str) -> str:
    return _BACK[label] if label in _BACK else re.sub(r"\\(.)", r"\1", label[1:], flags=re.S)


def marked_turns(turns: list[Turn]) -> str:
    """The template of the query: ``### Role: text</turn>`` lines."""
    return "".join(f"### {_label(role)}: {escape(text)}{END}\n" for role, text in turns)


@dataclass
class Rendered:
    text: str
    spans: list[tuple[int, int]]  # of each turn in text; none if history was rewritten
    mask: list[tuple[int, int]]  # of each assistant text in text; likewise
    rewritten_at: int | None  # first turn after which older output changed
    changed_from: int | None  # first changed position then


def _same(a: str, b: str) -> int:
    """Length of the common prefix, by halving: compares slices, not characters."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def render_incremental(template: Template, turns: list[Turn], window: int | None = None, learn: str = "assistant") -> Rendered:
    """Render successive prefixes and compare consecutive outputs.

    By default every prefix is whole, so a rewrite at any turn is found; the cost is
    that of the template, quadratic in the turns. With ``window`` the prefixes start
    that many turns back, which is right only for templates that look no further; it
    is never chosen by the size of a conversation. ``learn`` is the role whose texts
    the mask covers. A probe that the template does not show gives no mask.
    """
    spans, mask, parts = [], [], []
    before, length, base = template([]), 0, 0
    parts.append(before)
    length = len(before)
    for k, (role, _) in enumerate(turns):
        start = 0 if window is None else max(0, k // window - 1) * window
        if start != base:
            before, base = template(turns[start:k]), start
        now = template(turns[start : k + 1])
        if not now.startswith(before):
            return Rendered(template(turns), [], [], k, _same(before, now))
        if role == learn:
            p, q = (template([*turns[start:k], (role, probe)]) for probe in ("a", "b"))
            head, tail = _same(p, q), _same(p[::-1], q[::-1])
            if head < len(p) and len(now) - tail >= head and now[:head] == p[:head] and now[len(now) - tail :] == p[len(p) - tail :]:
                mask.append((length + head - len(before), length + len(now) - tail - len(before)))
        spans.append((length, length + len(now) - len(before)))
        parts.append(now[len(before) :])
        length += len(now) - len(before)
        before = now
    return Rendered("".join(parts), spans, mask, None, None)


def parse_marked(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn of ``marked_turns`` output; start and
    end bound the escaped text."""
    out, at = [], 0
    while at < len(text):
        head = _HEAD.match(text, at)
        if head is None:
            raise ValueError(f"no turn at {at}")
        start = end = head.end()
        while True:
            end = text.index(END, end)
            back = end
            while back > start and text[back - 1] == "\\":
                back -= 1
            if (end - back) % 2 == 0:
                break
            end += 1
        out.append((_role(head[1]), unescape(text[start:end]), start, end))
        at = end + len(END) + 1
    return out


def format_conversations(df: DataFrame, template: Template = marked_turns, window: int | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, spans of the turns, roles, mask
    (the ranges of assistant texts), rewritten_at, changed_from.

    Rows (conv_id, turn, role, text) are dealt by conv_id and read in order of
    (turn, role, text); null texts and roles are empty, null turns come first, a row
    with a null conv_id belongs to no conversation and is one of its own, repeated
    rows are turns of their own, other columns are ignored, no rows give no rows. A
    rewritten conversation has its final output and neither spans nor mask.
    Conversations stream through a task one at a time: memory is bounded by the
    longest conversation, not by how many share a task.
    """
    schema = "conv_id bigint, formatted string, spans array<struct<start:bigint,end:bigint>>, roles array<string>, mask array<struct<start:bigint,end:bigint>>, rewritten_at int, changed_from bigint"
    ranges = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64(), pa.string(), ranges, pa.list_(pa.string()), ranges, pa.int32(), pa.int64()]
    names = ["conv_id", "formatted", "spans", "roles", "mask", "rewritten_at", "changed_from"]

    def finish(conv_id, turns: list[Turn]) -> tuple:
        r = render_incremental(template, turns, window)
        spans, mask = ([{"start": a, "end": b} for a, b in x] for x in (r.spans, r.mask))
        return conv_id, r.text, spans, [x for x, _ in turns], mask, r.rewritten_at, r.changed_from

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, turns, out, size = (), [], [], 0
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if (conv_id,) != key or conv_id is None:
                    if key:
                        out.append(finish(key[0], turns))
                        size += len(out[-1][1])
                        if size > 1 << 22:
                            yield emit(out)
                            out, size = [], 0
                    key, turns = (conv_id,), []
                turns.append((role or "", text or ""))
        if key:
            out.append(finish(key[0], turns))
        if out:
            yield emit(out)

    rows = df.select(F.col("conv_id").cast("bigint"), "turn", "role", "text")
    # rows without a conversation are dealt by what they hold
    apart = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")).otherwise(F.col("conv_id"))
    rows = rows.repartition(apart).sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """What a trainer reads from ``marked_turns`` output: turn count and digest,
    the unescaped text under the loss mask, and the length."""
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, rewrites boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv_id, text, spans, mask, changed in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "spans", "mask", "rewritten_at"))):
                whole, loss, chars, n = hashlib.sha256(), hashlib.sha256(), 0, 0
                for span in spans:
                    for role, said, _, _ in parse_marked(text[span["start"] : span["end"]]):
                        whole.update(f"{role}\n{said}\n".encode())
                        n += 1
                for part in mask:
                    said = unescape(text[part["start"] : part["end"]])
                    loss.update(said.encode())
                    chars += len(said)
                rows.append((conv_id, n, whole.hexdigest(), chars, loss.hexdigest(), len(text), changed is not None))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return formatted.select("conv_id", "formatted", "spans", "mask", "rewritten_at").mapInArrow(run, schema)
