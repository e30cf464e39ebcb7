"""Text, title, URL and hash functions as column expressions.

Each tokeniser has its own stop words and stemmer; they are kept apart on purpose,
because rules built on one do not hold with another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Characters whose case folding is more than one letter.
FOLDS = {"ß": "ss", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: Stop words of title terms (risk grouping and candidate selection).
TITLE_STOPWORDS = ("about", "after", "amid", "and", "for", "from", "into", "says", "that", "the", "this", "with")
#: Query parameters that only track a reader.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref")
#: Marks between a title and its publisher.
SEPARATORS = (" - ", " | ", " – ", " — ")


def casefold(c: Column) -> Column:
    for char, folded in FOLDS.items():
        c = F.replace(c, F.lit(char), F.lit(folded))
    return F.lower(c)


def normalize_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(casefold(c), "[^a-z0-9$]+", " "))


def normalize_title(title: Column, source: Column) -> Column:
    """The title without a trailing publisher that equals its own source."""
    key = normalize_text(F.coalesce(source, F.lit("")))
    text = F.trim(title)
    out = text
    for mark in reversed(SEPARATORS):  # the first separator in the list wins
        tail = F.substring_index(text, mark, -1)
        head = F.left(text, F.length(text) - F.length(tail) - len(mark))
        fits = text.contains(mark) & (F.trim(head) != "") & (key != "") & (normalize_text(tail) == key)
        out = F.when(fits, head).otherwise(out)
    return normalize_text(out)


def strip_publisher(title: Column, source: Column) -> Column:
    mark = F.concat(F.lit(" - "), source)
    return F.when(title.endswith(mark), F.left(title, F.length(title) - F.length(mark))).otherwise(title)


def words(c: Column, least: int = 3) -> Column:
    return F.regexp_extract_all(casefold(c), F.lit(f"([a-z0-9]{{{least},}})"), F.lit(1))


def stem_suffix(t: Column) -> Column:
    """The first of ing, ed, es, s that leaves four letters goes."""
    out = t
    for suffix in reversed(("ing", "ed", "es", "s")):
        out = F.when(t.endswith(suffix) & (F.length(t) - len(suffix) >= 4), F.left(t, F.length(t) - len(suffix))).otherwise(out)
    return out


def stem_plural(t: Column) -> Column:
    """The selector's stemmer: sses, then a lone s, then ing and ed."""
    cut = lambda n: F.left(t, F.length(t) - n)
    long = lambda s: t.endswith(s) & (F.length(t) - len(s) >= 4)
    return (
        F.when(t.endswith("sses") & (F.length(t) > 5), cut(2))
        .when(t.endswith("s") & ~t.endswith("ss") & (F.length(t) > 4), cut(1))
        .when(long("ing"), cut(3))
        .when(long("ed"), cut(2))
        .otherwise(t)
    )


def _terms(c: Column, stop: tuple[str, ...], stem: Callable[[Column], Column] | None) -> Column:
    kept = F.filter(words(c), lambda t: ~t.isin(*stop))
    return F.array_distinct(F.transform(kept, stem) if stem else kept)


def title_terms(c: Column) -> Column:
    return _terms(c, TITLE_STOPWORDS, stem_suffix)


def selector_terms(c: Column) -> Column:
    return _terms(c, TITLE_STOPWORDS, stem_plural)


def plain_terms(c: Column, stop: tuple[str, ...]) -> Column:
    return _terms(c, stop, None)


def anchor_terms(title: Column, subject: Column) -> Column:
    """Stemmed names and numbers of a raw title (capitalised or with a digit, four
    letters at least) without the subject's own words."""
    own = F.transform(F.regexp_extract_all(casefold(subject), F.lit("([a-z0-9]+)"), F.lit(1)), stem_suffix)
    raw = F.regexp_extract_all(title, F.lit(r"([A-Za-z0-9$][\w$.-]*)"), F.lit(1))
    named = F.filter(raw, lambda t: t.rlike(r"^[A-Z]|[0-9]"))
    clean = F.transform(named, lambda t: stem_suffix(F.regexp_replace(casefold(t), "[^a-z0-9]", "")))
    return F.array_distinct(F.filter(clean, lambda t: (F.length(t) >= 4) & ~F.array_contains(own, t)))


def overlap(a: Column, b: Column) -> Column:
    """Shared terms over the smaller set; 0 where either is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))), F.lit(0.0))


def truncated(c: Column, length: int, ending: str) -> Column:
    """At most ``length`` characters with the ending, cut before trailing blanks."""
    return F.when(F.length(c) > length, F.concat(F.rtrim(F.left(c, F.lit(length - len(ending)))), F.lit(ending))).otherwise(c)


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" " + word), F.when(n == 1, "").otherwise("s"))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def host_is(h: Column, *domains: str) -> Column:
    out = F.lit(False)
    for d in domains:
        out = out | (h == d) | h.endswith("." + d)
    return out


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no tracking parameters, no slash at
    the end of the path; other parameters keep their order and blank values."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.regexp_replace(F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*:", ""), r"#.*$", "")
    net = F.lower(F.regexp_extract(rest, r"^//([^/?]*)", 1))
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"^//[^/?]*", ""), r"\?.*$", ""), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    # tracking parameters and empty ones go, the others get a "=" if they have none; by
    # patterns, which are compiled where functions over arrays are interpreted row by row.
    # Letters of ASCII alone fold to those of the names.
    kept = F.regexp_replace(F.concat(F.lit("&"), query), rf"(?i)&(?:utm_[^&]*|(?:{'|'.join(TRACKING)})(?:=[^&]*)?(?=&|\z)|(?=&|\z))", "")
    shaped = F.regexp_replace(kept, r"&([^=&]+)(?=&|\z)", "&$1=")
    tail = F.when(shaped != "", F.concat(F.lit("?"), F.substring(shaped, 2, 2**31 - 1))).otherwise("")
    return F.concat(scheme, F.lit("://"), net, F.when(path == "", "/").otherwise(path), tail)


def rss_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/rss/articles/([^?]*)", 1), F.lit(""))


def fingerprint(title: Column, ticker: Column, source: Column, published_at: Column) -> Column:
    stamp = F.concat(F.date_format(published_at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return F.sha2(F.concat_ws("|", casefold(ticker), normalize_text(title), normalize_text(source), stamp), 256)


def evidence_fingerprint(ids: Column) -> Column:
    return F.left(F.sha2(F.array_join(ids, "|"), 256), F.lit(32))


def html_to_text(html: Column) -> Column:
    """Tags out, common entities decoded, blanks collapsed, at most 4,000 characters."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.left(F.trim(F.regexp_replace(out, r"\s+", " ")), F.lit(4000))


def mentions(text: Column, phrase: Column) -> Column:
    """Whether a normalised text holds a normalised phrase between word bounds."""
    return F.concat(F.lit(" "), normalize_text(text), F.lit(" ")).contains(F.concat(F.lit(" "), normalize_text(phrase), F.lit(" ")))


def register(spark: SparkSession) -> None:
    """The same functions for SQL users, as SQL functions that the optimizer inlines."""
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION normalize_text(t STRING) RETURNS STRING RETURN trim(regexp_replace(lower(replace(t, 'ß', 'ss')), '[^a-z0-9$]+', ' '))")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION url_host(u STRING) RETURNS STRING RETURN lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1))")
    stop = ", ".join(f"'{w}'" for w in TITLE_STOPWORDS)
    spark.sql(rf"CREATE OR REPLACE TEMPORARY FUNCTION title_words(t STRING) RETURNS ARRAY<STRING> RETURN array_distinct(filter(regexp_extract_all(lower(t), '([a-z0-9]{{3,}})', 1), x -> x NOT IN ({stop})))")
