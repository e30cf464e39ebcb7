"""The training-data operators against brute force, round trips and awkward rows."""

import base64
import gzip
import html as entities
import itertools
import json
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsloom.llm import ann, chat, mixing, ngram_join, packing, queries, rans, secrets, shingles, tokens, topk, toxicity, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, sk string, family string"
AWKWARD = [
    (1, "", "en", "s", 0, "x", "y"), (2, None, None, None, None, None, None), (None, "a null id", "en", "s", 9, "x", "y"), (3, "one", "en", "s", 3, "x", "y"),
    (4, "same text here for two rows now", "en", "s", 0, "x", "y"), (4, "same text here for two rows now", "en", "s", 0, "x", "y"), (5, "  two  blanks\tand a tab\n\n", "en", "s", 0, "x", "y"),
    (6, "long " * 30_000, "en", "s", 0, "x", "y"), (7, "é ß 日本 <|endoftext|> 's.", "fr", "s", 0, "x", "y"), (7, "another text of the same id", "fr", "s", 0, "x", "y"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


# --- chat -----------------------------------------------------------------------------


def test_rendering_round_trips_and_finds_spans():
    rng = random.Random(1)
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "x:\\y", "", "System"]), "".join(rng.choice(["\\", "###", "</turn>", "a", "\n", "### User: "]) for _ in range(rng.randrange(8)))) for _ in range(rng.randrange(1, 40))]
        r = chat.render_incremental(chat.marked_turns, turns, window=8)
        assert [(a, b) for a, b, _, _ in chat.parse_marked(r.text)] == turns
        assert [r.text[a:b] for a, b in r.spans] == [chat.marked_turns([t]) for t in turns]
        assert [chat.unescape(r.text[a:b]) for a, b in r.mask] == [t for role, t in turns if role == "assistant"]
        assert chat.render_incremental(chat.marked_turns, turns) == r


def test_rewriting_templates_are_detected():
    keep_three = lambda turns: "".join(f"<{r}>{t}" for r, t in turns[-3:])
    assert chat.render_incremental(keep_three, [("a", str(i)) for i in range(6)]).rewritten_at == 3
    counts = lambda turns: f"[{len(turns)}]" + "".join(t for _, t in turns)
    assert chat.render_incremental(counts, [("a", "x")] * 3).changed_from == 1
    # a rewrite far from the start is found, though the last output extends the one before
    once = lambda turns: "SUMMARY" if len(turns) == 150 else "".join(f"<{r}>{t}" for r, t in turns)
    r = chat.render_incremental(once, [("assistant", str(i)) for i in range(200)])
    assert (r.rewritten_at, r.changed_from, r.spans, r.mask) == (149, 0, [], [])


def test_masks_of_templates_that_look_like_their_texts():
    quoted = lambda turns: "".join(f"[{r}]{t}{t}[/]" if r == "assistant" else f"[{r}]{t}[/]" for r, t in turns)
    assert chat.render_incremental(quoted, [("assistant", "x")]).mask == [(11, 13)]
    turns = [("user", "[/]"), ("assistant", "[/][/]"), ("assistant", ""), ("assistant", "]a[")]
    plain = lambda turns: "".join(f"[{r}]{t}[/]" for r, t in turns)
    r = chat.render_incremental(plain, turns)
    assert [r.text[a:b] for a, b in r.mask] == ["[/][/]", "", "]a["]


def test_a_conversation_of_many_turns(spark):
    rows = [(5, k, ("user", "assistant")[k % 2], "###" * (k % 3)) for k in range(400)]
    got = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))).collect()
    assert len(got) == 1 and got[0]["n_turns"] == 400 and not got[0]["rewrites"]
    assert got[0]["loss_chars"] == sum(len(r[3]) for r in rows if r[2] == "assistant")


def test_chat_handles_awkward_rows(spark):
    rows = [(None, 0, "user", "hi", 1), (None, 0, "user", "hi", 1), (1, None, None, None, 1), (1, 0, "assistant", "ok", 1), (1, 0, "assistant", "ok", 1)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted int")
    got = chat.read_back(chat.format_conversations(df)).collect()
    assert sorted((r["conv_id"] or 0, r["n_turns"], r["loss_chars"]) for r in got) == [(0, 1, 0), (0, 1, 0), (1, 3, 4)]
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


# --- tokens, packing, files -----------------------------------------------------------


def _plain_ids(texts):
    t = Tokenizer.from_file(queries.tokenizer_path())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def test_tokens_equal_the_library(docs):
    texts = [r[1] for r in AWKWARD] + ["", " ", "a ", " a", "\n", "a\n", "x.\ny", "it's. 's.", "a,b ,c!?", "5. é. end."] + [r["text"] for r in docs.limit(60).collect()]
    flat, counts = tokens.encode(pa.array(texts), queries.tokenizer_path())
    want = _plain_ids(texts)
    assert counts.tolist() == [len(x) for x in want]
    assert flat.tolist() == [i for x in want for i in x]


def test_tokens_of_odd_and_long_texts_equal_the_library(monkeypatch):
    monkeypatch.setattr(tokens, "_STRETCH", 64)
    rng = random.Random(9)
    bits = ["<|endoftext|>", "<|endof", "text|>", " ", "\n", "  ", "\t", "\u00a0", "a", "Bc", "\u00e9", "7", ".", "'s", "\u65e5", " the"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(600)] + ["".join(rng.choice(bits) for _ in range(3000)) for _ in range(5)]
    flat, counts = tokens.encode(pa.array(texts), queries.tokenizer_path())
    want = _plain_ids(texts)
    assert counts.tolist() == [len(x) for x in want] and flat.tolist() == [i for x in want for i in x]


def _check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_plan_uses_every_count_and_is_near_the_bound():
    rng = random.Random(5)
    for _ in range(60):
        capacity = rng.choice([5, 16, 64])
        counts = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(1, 12))}
        plan = packing.plan(dict(counts), capacity)
        used = {}
        for pattern, times in plan:
            assert sum(pattern) <= capacity
            for x in pattern:
                used[x] = used.get(x, 0) + times
        assert used == counts
        total = sum(k * n for k, n in counts.items())
        # no two lengths over half the capacity share a sequence
        bound = max(-(-total // capacity), sum(n for k, n in counts.items() if 2 * k > capacity))
        assert sum(t for _, t in plan) <= 1.5 * bound + 1
    assert packing.plan({7: 3, 2: 3, 1: 3}, 10) == [((7, 2, 1), 3)]
    assert packing.plan({5: 2, 3: 2, 2: 2}, 10) in ([((5, 5), 1), ((3, 3, 2, 2), 1)], [((5, 3, 2), 2)])


def _fewest(items, capacity):
    """The least number of sequences, by trying every place for every item."""
    items = sorted(items, reverse=True)
    best = [len(items)]

    def place(i, gaps):
        if len(gaps) >= best[0]:
            return
        if i == len(items):
            best[0] = len(gaps)
            return
        for gap in sorted(set(gaps)):
            if gap >= items[i]:
                k = gaps.index(gap)
                place(i + 1, gaps[:k] + [gap - items[i]] + gaps[k + 1 :])
        place(i + 1, [*gaps, capacity - items[i]])

    place(0, [])
    return best[0]


def test_plan_against_a_brute_force_packer():
    rng = random.Random(8)
    more = 0
    for _ in range(120):
        capacity = rng.choice([10, 20, 30])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = {x: items.count(x) for x in items}
        got, want = sum(t for _, t in packing.plan(counts, capacity)), _fewest(items, capacity)
        assert want <= got <= want + 1
        more += got - want
    assert more <= 6


def test_sums_find_what_fits_exactly():
    rng = random.Random(2)
    for _ in range(100):
        left = np.array([0, *(rng.choice([0, 0, 1, 2]) for _ in range(14))])
        total = rng.randint(1, 14)
        items = [x for x, n in enumerate(left) for _ in range(n)]
        for size, find in ((1, "single"), (2, "pair"), (3, "triple")):
            found = getattr(packing.Sums(left), find)(total)
            there = any(sum(c) == total for c in itertools.combinations(items, size))
            assert (found is not None) == there
            assert found is None or (sum(found) == total and all(found.count(x) <= left[x] for x in found))


def test_plan_edges():
    assert packing.plan({}, 10) == []


def test_packing_documents(spark, awkward, empty):
    got = packing.pack_documents(awkward, queries.tokenizer_path(), 2048).collect()
    want = _plain_ids([r[1] for r in AWKWARD])
    assert sum(r["length"] for r in got) == sum(map(len, want))
    _check_packing(got, 2048)
    long = sorted((r for r in got if r["doc_id"] == 6), key=lambda r: r["piece"])
    ids = want[7]
    assert [r["length"] for r in long[1:]] == [2048] * (len(long) - 1) and long[0]["length"] == len(ids) % 2048
    for r in long:
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert packing.pack_documents(empty, queries.tokenizer_path()).count() == 0


def test_rans_round_trip_checkpoints_and_checksums():
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.geometric(0.01, 4 * rans.BLOCK), 5000).astype(np.uint32)
    table = rans.Table(np.bincount(ids, minlength=6000))
    for n in (0, 1, rans.BLOCK, rans.BLOCK + 1, len(ids)):
        assert (table.decode(table.encode(ids[:n]), n) == ids[:n]).all()
    data = table.encode(ids)
    assert (table.decode(data, len(ids), range(2, 3)) == ids[2 * rans.BLOCK : 3 * rans.BLOCK]).all()
    p = np.bincount(ids) / len(ids)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum()
    assert len(data) * 8 / len(ids) < entropy * 1.05 + 0.2
    broken = bytearray(data)
    broken[len(data) // 2] ^= 1
    with pytest.raises(ValueError):
        table.decode(bytes(broken), len(ids))


def test_rans_files(awkward, empty):
    got = rans.round_trip(awkward, queries.tokenizer_path()).collect()
    order = sorted(zip([r[0] for r in AWKWARD], _plain_ids([r[1] for r in AWKWARD])), key=lambda x: (x[0] is not None, x[0] or 0, len(x[1])))
    at, want = 0, []
    for doc_id, ids in order:
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert rans.round_trip(empty, queries.tokenizer_path()).count() == 0


# --- WARC -----------------------------------------------------------------------------


def test_derivatives_link_back_and_check(spark):
    html = "<html><head><title>A &amp; B</title><script>no()</script></head><body><p>One</p><p>two <b>three</b></p><a href='/x?a=1&amp;b=2'>go</a></body></html>"
    source = warc.response("https://e.org/d/", html, "2024-01-01T00:00:00Z", "1")
    head, block = warc.parse(source)
    (m, meta), (c, conv) = warc.derive(source)
    assert (m, c) == ("metadata", "conversion")
    own, facts = warc.parse(meta)
    facts = json.loads(facts)
    assert dict(own)["WARC-Refers-To"] == dict(head)["WARC-Record-ID"] and dict(facts["source"])["WARC-Target-URI"] == "https://e.org/d/"
    assert facts["html"]["title"] == "A & B" and facts["html"]["links"] == [{"tag": "a", "url": "https://e.org/x?a=1&b=2"}]
    own, text = warc.parse(conv)
    assert text.decode() == "A & B\nOne\ntwo three\ngo" and dict(own)["WARC-Block-Digest"] == warc.digest(text)
    assert dict(own)["WARC-Source-Payload-Digest"] == dict(head)["WARC-Payload-Digest"]
    with pytest.raises(ValueError):
        warc.derive(source.replace(b"three", b"threw"))
    rows = spark.createDataFrame([(1, "u", html, "z"), (1, "u", html, "z"), (2, None, None, "z"), (None, "v", "", "z")], "page_id bigint, url string, html string, kind string")
    got = warc.build(rows)
    assert got.count() == 4 and got.where("valid").count() == 4
    assert warc.build(rows.limit(0)).count() == 0
    apart = warc.derivatives(warc.responses(rows)).collect()
    assert sorted(map(str, apart)) == sorted(map(str, warc.page_derivatives(rows).collect()))


@pytest.mark.parametrize("n", [0, 1, 600, 40000, 300000])
def test_gzip_members_hold_their_data(n):
    import gzip

    data = (b"some text, " * (n // 11 + 1))[: n // 2] + np.random.default_rng(n).bytes(n - n // 2)
    member = warc.pack(data)
    assert gzip.decompress(member) == warc.unpack(member) == data
    assert gzip.decompress(member + warc.pack(b"next")) == data + b"next"
    with pytest.raises(zlib.error):
        warc.unpack(member[:-1])


@pytest.mark.parametrize("piece", ["<meta name=a ", "<!--", "<script>", "<title>", '<a href="', "<a ", "<a 'x=\">", "</script  ", "&#9", "<svg"])
def test_hostile_pages_take_linear_time(piece):
    began = time.process_time()
    got = warc.derive(warc.response("http://a/b", (piece * (1 << 20))[: 1 << 20], "d", "1"))
    assert [k for k, _ in got] == ["metadata", "conversion"] and time.process_time() - began < 2


def _plainly(html):
    """Title, text, links and meta by the plain patterns, for small well-formed pages."""
    bare = re.sub(r"(?is)<!--.*?-->|<(script|style|noscript|template|svg)\b[^>]*>.*?</\1\s*>", " ", html)
    text = re.sub(r"<[!/?a-zA-Z][^>]*>", "", re.sub(r"(?i)</?(p|div|title|br|li|h1)\b[^>]*>", "\n", bare))
    lines = [" ".join(x.split()) for x in entities.unescape(text).split("\n")]
    title = re.search(r"(?is)<title\b[^>]*>(.*?)</title\s*>", html)
    links = [entities.unescape(x) for x in re.findall(r"""(?i)<(?:a|img|link|iframe)\b[^>]*?\s(?:href|src)="([^"]*)\"""", bare)]
    return "\n".join(x for x in lines if x), title and " ".join(entities.unescape(title[1]).split()), links, re.findall(r'(?i)<meta name="([^"]*)" content="([^"]*)"', html)


def test_both_records_against_plain_patterns():
    rng = random.Random(6)
    bits = ["<p>", "</p>", "<title>T &lt; U</title>", "<!-- <p> -->", "<script>if (a<b) x('</p>')</script>", '<a class="k" href="/x?a=1&amp;b">', "</a>", "word ", " &amp; ", "\n", '<meta name="k" content="v w">', '<img src="i.png">', "<svg><a href='no'></svg>", "<br/>", "5 < 6 ", "<STYLE>p{}</STYLE >"]
    for _ in range(300):
        html = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        got = dict(warc.derive(warc.response("http://h/d/e", html, "d", "1")))
        text, title, links, meta = _plainly(html)
        facts = json.loads(warc.parse(got["metadata"])[1])["html"]
        assert warc.parse(got["conversion"])[1].decode() == text
        assert facts["title"] == title and facts["meta"] == [list(x) for x in meta]
        assert [x["url"] for x in facts["links"]] == [warc.urljoin("http://h/d/e", x) for x in links]


def _message(body, *headers):
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return warc.serialize([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Concurrent-To", "<urn:a>"), ("WARC-Concurrent-To", "<urn:b>"), ("WARC-Date", "d"), ("WARC-Target-URI", "http://h/")], f"HTTP/1.1 200 OK\r\n{head}\r\n".encode() + body)


def test_codings_are_undone_and_headers_kept():
    page = b"<p>one</p><p>two</p>"
    chunked = b"".join(f"{len(x):x}\r\n".encode() + x + b"\r\n" for x in (page[:7], page[7:])) + b"0\r\n\r\n"
    packed = gzip.compress(page)
    for body, headers in ((page, ()), (chunked, (("Transfer-Encoding", "chunked"),)), (packed, (("Content-Encoding", "gzip"),)), (zlib.compress(page), (("Content-Encoding", "deflate"),)), (b"%x\r\n" % len(packed) + packed + b"\r\n0\r\n\r\n", (("Transfer-Encoding", "chunked"), ("Content-Encoding", "gzip")))):
        got = dict(warc.derive(_message(body, ("Content-Type", "text/html"), *headers)))
        assert warc.parse(got["conversion"])[1] == b"one\ntwo"
        source = json.loads(warc.parse(got["metadata"])[1])["source"]
        assert [v for k, v in source if k == "WARC-Concurrent-To"] == ["<urn:a>", "<urn:b>"]
    assert [k for k, _ in warc.derive(_message(b"\x89PNG", ("Content-Type", "image/png")))] == ["metadata"]
    assert [k for k, _ in warc.derive(_message(b"??", ("Content-Type", "text/html"), ("Content-Encoding", "br")))] == ["metadata"]
    plain = dict(warc.derive(_message(b"a < b <c>", ("Content-Type", "text/plain"))))
    assert warc.parse(plain["conversion"])[1] == b"a < b <c>"


def test_files_are_read(spark, tmp_path):
    pages = [warc.response(f"http://h/{i}", f"<p>{i}</p>" * 50, "d", str(i)) for i in range(40)]
    other = warc.serialize([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:r>")], b"GET / HTTP/1.1\r\n\r\n")
    (tmp_path / "a.warc.gz").write_bytes(b"".join(warc.pack(x) for x in [other, *pages[:20]]))
    (tmp_path / "b.warc").write_bytes(b"".join([*pages[20:], other]))
    got = warc.from_files(spark, str(tmp_path))
    assert sorted(r["record"] for r in got.collect()) == sorted(bytearray(x) for x in pages)
    assert warc.derivatives(got).groupBy("kind").count().where("count = 40").count() == 3
    with pytest.raises(ValueError):
        list(warc.records(warc.pack(pages[0])[:-9]))


def test_rooted_links_join_like_others():
    from urllib.parse import urljoin

    for base in ("http://e.org/a/b.html", "HTTPS://E.org", "", "mailto:x", "//h/x"):
        for path in ("/", "/a", "//b", "/.", "/a/../b", "/a?", "/a#x", "/a b", "/ä/c.html", "/a;p", "/...", "/a/.b"):
            html = f"<a href='{path}'>x</a>"
            (_, meta), _ = warc.derive(warc.response(base, html, "d", "1"))
            assert json.loads(warc.parse(meta)[1])["html"]["links"][0]["url"] == urljoin(base, path)


# --- near duplicates ------------------------------------------------------------------


def _brute_links(texts, threshold=0.8):
    flat, o = shingles.shingle(pa.array(texts, pa.string()))
    sets = [frozenset(flat[a:b].tolist()) for a, b in zip(o[:-1], o[1:])]
    out = [[] for _ in sets]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and (a == b or (a and b and len(a & b) >= threshold * len(a | b) - 1e-9)):
                out[i].append(j)
    return out


def _variants(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([3, 12, 60, 200]))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(12)):
            copy = base[:]
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy) + rng.choice(["", ".", "!"]))
    return out + ["", "!!", None, "one", "One."]


def test_near_duplicates_against_all_pairs(spark):
    texts = _variants(1)
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id bigint, text string, class_id string")
    got = {r["doc_id"]: r for r in ngram_join.near_duplicates(df.repartition(4)).collect()}
    links = _brute_links(texts)
    assert {i: got[i]["n_links"] for i in got} == {i: len(x) for i, x in enumerate(links)}
    for i in range(len(texts)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert got[i]["class_id"] == min(seen)
    kept = {r["doc_id"] for r in ngram_join.keep_one(df).collect()}
    assert kept == {r["class_id"] for r in got.values()}


def test_large_families_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "HUB", 3)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(60):
        copy = base[:]
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(120)] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_links"] for r in ngram_join.near_duplicates(df).collect()}
    assert got == {i: len(x) for i, x in enumerate(_brute_links(texts))}


def test_near_duplicates_awkward(awkward, empty):
    got = ngram_join.near_duplicates(awkward).collect()
    assert len(got) == len(AWKWARD)
    assert {(r["doc_id"], r["class_id"]) for r in got if r["doc_id"] in (1, 2, 4)} == {(1, 1), (2, 1), (4, 4)}
    assert ngram_join.near_duplicates(empty).count() == 0
    kept = ngram_join.keep_one(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id = 4").count() == 1 and kept.where("doc_id = 2").count() == 0


def test_one_of_each_class_stays(spark):
    a, near = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(59))
    b, c = " ".join(f"x{i}" for i in range(60)), " ".join(f"y{i}" for i in range(60))
    rows = [(1, a), (2, near), (2, b), (3, c), (3, c), (None, a), (None, b + "!"), (None, "alone here"), (None, "alone here"), (4, "")]
    df = spark.createDataFrame([(i, t, "s", 1, "k") for i, t in rows], "doc_id bigint, text string, _set string, n int, sk string").repartition(4)
    got = ngram_join.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"][:5]) for r in got.collect()) == [(0, "alone"), (1, "w0 w1"), (2, "x0 x1"), (3, "y0 y1"), (4, "")]


def test_pruning_bound():
    least = ngram_join.least_matches(0.8)
    assert list(least) == sorted(least) and least[-1] < 0.8 * ngram_join.HASHES


# --- toxicity -------------------------------------------------------------------------


def test_toxicity_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.1"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(d, lab)
    got = toxicity.score(d, model).join(lab, "doc_id").where(toxicity.held_out())
    tp, fp, fn = (got.where(c).count() for c in ("predicted = 1 and toxic = 1", "predicted = 1 and toxic = 0", "predicted = 0 and toxic = 1"))
    print(tp, fp, fn)
    # few labels here, and forms that clean documents hold by chance
    assert tp > 50 and tp / (tp + fp) > 0.8 and tp / (tp + fn) > 0.7
    p = lambda t: float(model.probability(pa.array([t]))[0])
    plain = p("an idiot and a stupid clown, some trash")
    assert plain >= 0.7
    for disguised in ("an i.d.i.o.t and a st.upid c-l-o-w-n, some tr_ash", "an i d i o t and a stupid c l o w n, some trash", "an 1di0t and a stup1d cl0wn, some tra$h"):
        assert p(disguised) >= plain - 0.05, disguised
    assert p("the quiet river runs by the meadow") < 0.3 and p("") < 0.3


def test_kernel_features_match_a_plain_sum():
    units = ["idiot", "abcabc", "zz"]
    got = toxicity.features(units)
    for u, row in zip(units, got):
        want = {}
        codes = [ord(c) - 96 for c in u]
        for i in range(len(u)):
            for j in range(i + 1, len(u)):
                for k in range(j + 1, min(len(u), i + toxicity.SPAN)):
                    key = (codes[i] * toxicity.LETTERS + codes[j]) * toxicity.LETTERS + codes[k]
                    want[key] = want.get(key, 0) + toxicity.GAP ** (k - i - 2)
        norm = sum(v * v for v in want.values()) ** 0.5 or 1
        assert {k: pytest.approx(v / norm, abs=1e-5) for k, v in want.items()} == {int(k): float(row[k]) for k in np.flatnonzero(row)}


def test_toxicity_awkward(spark, awkward, empty):
    model = toxicity.train(["good day", "you idiot", "fine day", "an idiot"] * 20, [0, 1, 0, 1] * 20)
    assert toxicity.score(awkward, model).count() == len(AWKWARD)
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit(awkward, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert toxicity.drop_toxic(awkward, none).count() == len(AWKWARD)


# --- secrets --------------------------------------------------------------------------


def _der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else (lambda b: bytes([0x80 | len(b)]) + b)(n.to_bytes((n.bit_length() + 7) // 8, "big"))
    return bytes([tag]) + size + body


def test_secrets_against_the_contract():
    rng = random.Random(8)
    parts = ["password", "Token", "api_key", "APIKEY", '"', "'", " ", ":", "=", "AKIA", "0123456789ABCDEF", "deadbeef", "00ff", "x", "é", "\n", "=", "secret", "Zz9/+._-"]
    plain = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        want = [("assign", *m.span()) for m in plain.finditer(text) if len(m[1]) >= 12]
        want += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        want += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
        base, every = secrets.scan(text)
        assert sorted(base) == sorted(want) and set(base) <= set(every)
        assert [(s[1], secrets.KINDS.index(s[0])) for s in base] == sorted((s[1], secrets.KINDS.index(s[0])) for s in base)


def test_structures_are_confirmed():
    b64 = lambda b: base64.b64encode(b).decode()
    url = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    key = _der(0x30, _der(2, b"\0"), _der(2, bytes([0x41]) * 128), _der(2, b"\1\0\1"))
    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = field(b"ssh-rsa") + field(b"\1\0\1") + field(b"\0" + bytes([7]) * 64)
    jwt = f"{url(json.dumps({'alg': 'HS256', 'typ': 'JWT'}).encode())}.{url(b'{}')}.{url(bytes(32))}"
    kinds = lambda t: [k for k, _, _ in secrets.confirmed_spans(t)]
    assert kinds("x " + b64(key)) == ["der"] and kinds("k " + b64(ssh)) == ["ssh"] and kinds("t " + jwt + ".") == ["jwt"]
    assert kinds("h " + key.hex()) == ["hexder"]
    assert kinds("x " + b64(key[:-1])) == [] and kinds("x " + b64(key[:4] + b"\x05" + key[5:])) == []
    assert kinds("eyJhbGciOiJub3RqdyJ9x.abcd.efgh") == [] or not secrets.is_signed_token("eyJ9.a.b")
    assert kinds("-----BEGIN RSA PRIVATE KEY-----\n" + b64(key) + "\n-----END RSA PRIVATE KEY-----").count("pem") == 1
    assert secrets.redact("ab token=abcdefghijklmnop cd", secrets.scan("ab token=abcdefghijklmnop cd")[1]) == "ab [secret] cd"


def test_structures_in_other_spellings_are_confirmed():
    b64 = lambda b: base64.b64encode(b).decode()
    url = lambda b: base64.urlsafe_b64encode(b).decode().rstrip("=")
    fold = lambda t: "\n".join(t[i : i + 64] for i in range(0, len(t), 64))
    field = lambda b: len(b).to_bytes(4, "big") + b
    key = _der(0x30, _der(2, b"\0"), _der(2, bytes([0x7B, 0xEF, 0xFF]) * 43), _der(2, b"\1\0\1"))
    public = field(b"ssh-rsa") + field(b"\1\0\1") + field(b"\0" + bytes([7]) * 64)
    openssh = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(public) + field(bytes(80))
    found = lambda t: [(k, t[a:b]) for k, a, b in secrets.confirmed_spans(t)]
    for header in (b'{ "alg": "HS256"}', b'{\n "alg": "HS256"\n}', b' {"alg": "HS256"}'):
        token = f"{url(header)}.{url(b'{}')}.{url(bytes(32))}"
        assert found(f"t {token} x") == [("jwt", token)] and secrets.scan(f"t {token} x")[1]
    assert url(key) != b64(key).rstrip("=")
    for text in (fold(b64(key)), url(key), fold(url(key))):
        assert found(f"k {text}\nword") == [("der", text)] and secrets.scan(f"k {text}\nword")[1]
    for text in (key.hex().upper(), fold(key.hex()), fold(key.hex().upper())):
        assert found(f"h {text}\nword") == [("hexder", text)]
    assert found("k " + fold(b64(public))) == [("ssh", fold(b64(public)))]
    pem = lambda kind, head, body: f"-----BEGIN {kind}-----\n{head}{fold(b64(body))}\n-----END {kind}-----"
    locked = pem("RSA PRIVATE KEY", "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n", bytes(range(96)))
    assert ("pem", locked) in found(locked)
    assert "pem" in dict(found(pem("OPENSSH PRIVATE KEY", "", openssh)))
    assert "pem" not in dict(found(pem("OPENSSH PRIVATE KEY", "", openssh[:-1])))
    assert found("k " + fold(b64(key[:-1]))) == []


def test_secrets_awkward(awkward, empty):
    got = secrets.find_secrets(awkward).collect()
    assert len(got) == len(AWKWARD) and all(r["spans"] == "" for r in got)
    assert secrets.find_secrets(empty).count() == 0
    out = secrets.redact_documents(awkward)
    assert out.columns == awkward.columns and out.where("text is null").count() == 1


# --- vector searches ------------------------------------------------------------------


def _vectors(spark, n, seed):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(12, 16))[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, 16))).astype(np.float32)
    x[10:20] = x[10]
    rows = [(i, [float(v) for v in x[i]], 1, "r") for i in range(n)]
    bad = [(n, None, 1, "r"), (n + 1, [float("nan")] * 16, 1, "r"), (n + 2, [None] + [1.0] * 15, 1, "r"), (None, [1.0] * 16, 1, "r"), (n + 3, [float("inf")] + [0.0] * 15, 1, "r"), rows[5]]
    zero = (-(-n // 50) * 50 + 50, [0.0] * 16, 1, "r")
    return spark.createDataFrame([*rows, *bad, zero], "vec_id bigint, embedding array<float>, label int, rank string").repartition(4), x.astype(np.float64), zero[0]


def test_nearest_recall_and_ties(spark):
    df, x, _ = _vectors(spark, 1500, 1)
    got = ann.nearest(df).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 50):
        s = u @ u[q]
        s[q] = -9
        want = set(np.lexsort((np.arange(1500), -np.round(s, 10)))[:5].tolist())
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        for r in own:
            assert r["score"] == pytest.approx(float(u[q] @ u[r["vec_id"]]), abs=1e-12)
        hits += len(want & {r["vec_id"] for r in own})
    assert hits / 150 >= 0.9
    assert ann.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind,probes,least", [("independent", 2, 0.9), ("families", 2, 0.9), ("independent", 256, 1)])
def test_nearest_recall_when_lists_outnumber_probes(spark, monkeypatch, kind, probes, least):
    monkeypatch.setattr(ann, "LIST", 16)
    monkeypatch.setattr(ann, "PROBES", probes)
    n, rng = 3000, np.random.default_rng(11)
    x = rng.normal(size=(n, 64))
    if kind == "families":
        x = rng.normal(size=(8, 64))[rng.integers(0, 8, n)] + 0.5 * x
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(4)
    got = {(r["query_id"], r["vec_id"]) for r in ann.nearest(df).collect()}
    s = u[::50] @ u.T
    s[np.arange(n // 50), np.arange(0, n, 50)] = -9
    want = {(50 * q, int(i)) for q, row in enumerate(np.argsort(-s, axis=1)[:, :5]) for i in row}
    assert len(got) == len(want) == n // 10
    assert len(got & want) / len(want) >= least


def test_nearest_is_complete_for_queries_at_centroids(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 32)
    monkeypatch.setattr(ann, "PROBES", 2)
    rng = np.random.default_rng(2)
    n = 1200
    x = rng.normal(size=(4, 16))[rng.integers(0, 4, n)] + 0.1 * rng.normal(size=(n, 16))
    for j, q in enumerate(range(0, 600, 50)):  # outliers that are queries, each almost a list of its own
        x[q] = 0
        x[q, j] = 50 if j % 2 else -50
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(3)
    got = ann.nearest(df).groupBy("query_id").count().collect()
    assert len(got) == n // 50 and all(r["count"] == 5 for r in got)
    few = ann.nearest(df.where("vec_id < 3")).collect()
    assert [(r["query_id"], r["rank"]) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1), (0, 2)]
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(120)], "vec_id bigint, embedding array<double>")
    assert {(r["query_id"], r["vec_id"]) for r in ann.nearest(same).collect() if r["query_id"] == 50} == {(50, i) for i in range(5)}


def test_recall_on_the_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = {(r["query_id"], r["vec_id"]) for r in ann.nearest(df).collect()}
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect() if r["vec_id"] is not None and r["embedding"] is not None]
    rows = sorted((i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v))
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for row in np.flatnonzero(ids % 50 == 0):
        s = u @ u[row]
        s[row] = -9
        want |= {(int(ids[row]), int(ids[i])) for i in np.lexsort((ids, -s))[:5]}
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.9


def test_top_inner_products_are_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 200)
    monkeypatch.setattr(topk, "LEAF", 16)
    df, x, zero = _vectors(spark, 1000, 2)
    ids = np.append(np.arange(1000), zero)
    z = np.vstack([np.floor(256 * x), np.zeros(16)]).astype(np.int64)
    got = topk.top_inner_products(df).collect()
    for row, q in enumerate(ids):
        if q % 50:
            continue
        s = z @ z[row]
        s[row] = -(2**62)
        want = np.lexsort((ids, -s))[:5]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [(r["vec_id"], r["score"]) for r in own] == [(int(ids[i]), int(s[i])) for i in want]
    assert topk.top_inner_products(df.limit(0)).count() == 0


def test_ball_tree_prunes():
    rng = np.random.default_rng(3)
    x = np.floor(256 * (np.repeat(rng.normal(size=(20, 8)) * 5, 100, axis=0) + 0.1 * rng.normal(size=(2000, 8)))).astype(np.int64)
    tree = topk.BallTree(x, np.arange(2000))
    ids, got, visits = tree.search(x[:50], np.arange(50), 5, None, False)
    leaves = sum(m is not None for m in tree.members)
    assert visits < 50 * leaves / 2
    s = x[:50] @ x.T
    s[np.arange(50), np.arange(50)] = -(2**62)
    assert all(sorted(row)[-5:] == sorted(g.tolist()) for row, g in zip(s.tolist(), got))


# --- mixing ---------------------------------------------------------------------------


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.4, 0.4, 0.4], 500)
    t = rng.integers(1, 300, 500)
    df = spark.createDataFrame([(int(n), [float(v) for v in row]) for n, row in zip(t, p)], "n_tokens bigint, p array<double>")
    weights = {"a": 0.7, "b": 0.25, "c": 0.05}
    r = mixing.fit_rates(df, ["a", "b", "c"], weights)
    rate = r.of(p)
    assert (rate >= 0).all()
    have = (rate * t) @ p
    assert have / have.sum() == pytest.approx([0.7, 0.25, 0.05], abs=0.01) and have.sum() == pytest.approx(t.sum(), rel=0.01)


def _least(p, t, target):
    """The least distance from the target, by many plain accelerated steps."""
    d = np.sqrt(t)
    a = p * d[:, None]
    length = np.linalg.norm(a, 2) ** 2
    s, y, pace = d.copy(), d.copy(), 1.0
    for _ in range(20_000):
        new = np.maximum(0, y - a @ (a.T @ y - target) / length)
        following = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        if ((y - new) * (new - s)).sum() > 0:
            pace = following = 1.0
            new = np.maximum(0, s - a @ (a.T @ s - target) / length)
        y, s, pace = new + (pace - 1) / following * (new - s), new, following
    return np.linalg.norm(a.T @ s - target) / target.sum()


@pytest.mark.parametrize("mass,weights", [(3, (0.98, 0.01, 0.01)), (30, (0.9, 0.05, 0.05)), (0.2, (0, 0, 1)), (0.3, (0.1, 0.2, 0.7))])
def test_rates_are_least_squares_for_hard_targets(spark, mass, weights):
    rng = np.random.default_rng(4)
    p, t = rng.dirichlet([mass] * 3, 400), rng.integers(1, 300, 400).astype(float)
    df = spark.createDataFrame([(int(n), [float(v) for v in row]) for n, row in zip(t, p)], "n_tokens bigint, p array<double>").repartition(3).cache()
    r = mixing.fit_rates(df, list("abc"), dict(zip("abc", weights)))
    rate = r.of(p)
    error = np.linalg.norm((rate * t) @ p - r.targets) / r.targets.sum()
    assert error == pytest.approx(r.error, abs=1e-9) and r.moved < 1e-3 and (rate >= 0).all()
    assert error <= _least(p, t, r.targets) + 2.5e-3


def test_copies_leave_in_bounded_batches(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "x" * 1000, "s", 1, 2) for i in range(20)], "doc_id bigint, text string, _u string, _chance int, copies int")
    model = mixing.Classifier(["all"], np.zeros((mixing.HASHED + 1, 1), np.float32))
    rates = mixing.Rates(["all"], np.ones(1), [(0.0, np.array([-96.0]))])
    got = mixing.apply_rates(rows, model, rates)
    assert got.columns == rows.columns and got.count() == 97 * 20
    assert got.where("_u = 's' and _chance = 1").count() == 97 * 20


def test_mixing_documents(spark, small, awkward, empty):
    d, lab = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    got = mixing.document_rates(d, lab, queries.MIX)
    assert got.count() == d.count() and got.where("rate < 0").count() == 0
    for rows in (awkward, empty):
        out = mixing.document_rates(rows, lab, queries.MIX)
        assert out.count() == rows.count()
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert mixing.document_rates(awkward, none, {"all": 1.0}).where("abs(rate - 1) < 1e-6").count() == len(AWKWARD)
    model, rates, _ = mixing.fit(d, lab, queries.MIX)
    mixed = mixing.apply_rates(d, model, rates)
    assert mixed.columns == d.columns
    assert mixed.count() == got.agg(F.sum("copies")).first()[0]


# --- pipeline -------------------------------------------------------------------------


def test_pipeline_stages(spark, small, awkward, empty):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, small).collect()
    assert out and _check_packing(out, queries.CAPACITY) >= 1
    for rows in (awkward, empty):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, rows, small)
            if name != "best_fit_packing":
                assert got.columns == rows.columns
            got.count()


def test_what_the_stages_keep_against_plainer_versions(spark, small):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet")))
    mild = {r["doc_id"] for r in scored.where("predicted = 0").collect()}
    assert {r["doc_id"] for r in stages["toxicity"](spark, docs, small).collect()} == mild

    variants = spark.createDataFrame([(i, t) for i, t in enumerate(_variants(21))], "doc_id bigint, text string")
    texts = [t for t in _variants(21)]
    links, seen, least = _brute_links(texts), set(), []
    for i in range(len(texts)):
        if i not in seen:  # the first met of a component is its least
            least.append(i)
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in seen:
                    seen.add(k)
                    todo += links[k]
    assert sorted(r["doc_id"] for r in stages["ngram_jaccard_join"](spark, variants, small).collect()) == least

    mixed = stages["mixing"](spark, docs, small).groupBy("doc_id").count().collect()
    want = {r["doc_id"]: r["copies"] for r in queries.op9_soft_mixing(spark, small).collect() if r["copies"]}
    assert {r["doc_id"]: r["count"] for r in mixed} == want

    packed = stages["best_fit_packing"](spark, docs, small).collect()
    ids = _plain_ids([r["text"] for r in docs.collect()])
    assert sum(r["length"] for r in packed) == sum(map(len, ids)) and _check_packing(packed, queries.CAPACITY) >= -(-sum(map(len, ids)) // queries.CAPACITY)


def test_training_holds_little_on_the_driver():
    import tracemalloc

    def peak(f):
        tracemalloc.start()
        try:
            f()
            return tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    units = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    assert peak(lambda: toxicity._gram_evidence(units, np.ones(200), np.zeros(200), 0.5, 5)) < 20
    model = toxicity.Model(np.zeros(toxicity.LETTERS**3), 0.0, np.zeros(toxicity.BEST + 1))
    assert peak(lambda: model.units(["abcdefgh" * 6] * 4096)) < 30
    assert peak(lambda: mixing.train([f"text {k}" for k in range(4000)], ["a", "b"] * 2000, rounds=1)) < 90
