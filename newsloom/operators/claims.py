"""Claims of an article: validation, corroboration, evidence, gates, related companies.

An analysed article carries ``claims`` (their number), ``assessments``
array<struct<claim_id, status, cited array<id>>> and ``evidence``
array<struct<article_id, source, url, title, published_s>>. Everything is a column
expression over one row, so nothing is shuffled. Null arrays count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import maths, rules, text

DECISIVE = ("corroborated", "contradicted")
RESTATED_S, RESTATED = 48 * 3600, 0.75
# Strength of a primary source by its class.
PRIMARY = {"official_company": 0.45, "regulatory_or_filing": 0.45, "major_financial_news": 0.35, "industry_specialist": 0.25, "general_news": 0.20, "commentary_or_opinion": 0.10, "unknown": 0.05}
# Words that evidence terms leave out.
EVIDENCE_STOPWORDS = ("with", "from", "that", "this", "will", "after", "about")
# What shows in supplied text that a public authority acted.
INSTITUTIONS = (r"\bgovernments?\b", r"\bregulators?\b", r"\bregulations?\b", r"\bantitrust\b", r"competition\s+authorit(?:y|ies)", r"\bministry\b", r"\blegislatures?\b", r"\bwatchdog\b", r"state[-\s](?:owned|run|users?|sector|authorit(?:y|ies))")
NAMED_REGULATORS = ("SEC", "FTC", "DOJ", "CFIUS")
STATES = (r"\bchina\b", r"\bchinese\b", r"\bunited\s+states\b", r"\beuropean\s+union\b", r"\bunited\s+kingdom\b")
STATE_INITIALS = (r"\bU\.S\.", r"\bEU\b", r"\bUK\b")
STATE_ACTS = (r"\bbans?\b", r"\bbanned\b", r"\bbanning\b", r"\brestrict\w*\b", r"\beas(?:e|es|ed|ing)\b", r"\bimpos\w*\b", r"\bsanction\w*\b", r"\bembargo\w*\b", r"export\s+(?:control|controls|restriction|restrictions)", r"\brevok\w*\s+(?:a\s+)?licen[cs]e")


def _cited(a: Column) -> Column:
    return F.coalesce(a["cited"], F.expr("cast(array() as array<bigint>)"))


def claim_error(claims: Column, assessments: Column, evidence_ids: Column) -> Column:
    """The first thing wrong with the assessments, in their order, or null: a claim that
    was not supplied or is assessed twice, a citation that was not supplied, a decisive
    status without one."""

    def wrong(a: Column, i: Column) -> Column:
        number = F.expr("try_cast(null as int)") if a is None else F.regexp_extract(a["claim_id"], r"^claim_([1-9][0-9]*)$", 1).try_cast("int")
        before = F.exists(F.slice(assessments, F.lit(1), i), lambda b: b["claim_id"] == a["claim_id"])
        return (
            F.when(F.coalesce(number > claims, F.lit(True)) | before, "unknown_or_repeated_claim")
            .when(F.size(F.array_except(_cited(a), evidence_ids)) > 0, "citation_not_supplied")
            .when(a["status"].isin(*DECISIVE) & (F.size(_cited(a)) == 0), "decision_without_citation")
        )

    return F.get(F.filter(F.transform(assessments, wrong), lambda x: x.isNotNull()), 0)


def related_companies(proposed: Column, allowed: Column, subject: Column) -> Column:
    """Upper-case symbols proposed, each once and in order, that are allowed and not the
    company itself."""
    upper = lambda c: F.transform(c, lambda x: F.upper(x))
    known = upper(allowed)
    return F.array_distinct(F.filter(upper(proposed), lambda x: F.array_contains(known, x) & (x != F.upper(subject))))


def restates(title: Column, published_s: Column, other: Column, other_s: Column) -> Column:
    """Within 48 hours and three quarters of the smaller title's terms shared."""
    return (F.abs(published_s - other_s) <= RESTATED_S) & (text.overlap(text.title_terms(title), text.title_terms(other)) >= RESTATED)


def corroboration(articles: DataFrame) -> DataFrame:
    """Adds total, corroborated, contradicted, unresolved, supporting, external and
    is_official: decisive claims need a citation; support is what corroborated claims
    cite; external are its organisations other than the article's own, without rewrites
    of the article."""
    decided = lambda status: F.filter("assessments", lambda a: (a["status"] == status) & (F.size(_cited(a)) > 0))
    own = rules.organisation(F.col("source"), F.col("url"), F.col("title"))
    ids = F.array_distinct(F.flatten(F.transform(decided("corroborated"), _cited)))
    out = articles.withColumn("assessments", F.coalesce("assessments", F.expr("cast(array() as array<struct<claim_id:string,status:string,cited:array<bigint>>>)")))
    out = out.withColumn("_ids", ids).withColumn("_own", own)
    support = F.filter("evidence", lambda e: F.array_contains(F.col("_ids"), e["article_id"]))
    out = out.withColumn("_support", F.coalesce(support, F.array()))
    foreign = F.filter("_support", lambda e: (rules.organisation(e["source"], e["url"], e["title"]) != F.col("_own")) & ~restates(F.col("title"), F.col("published_s"), e["title"], e["published_s"]))
    organisations = F.array_distinct(F.transform(foreign, lambda e: rules.organisation(e["source"], e["url"], e["title"])))
    out = out.withColumns({"total": F.size("assessments"), "corroborated": F.size(decided("corroborated")), "contradicted": F.size(decided("contradicted")), "supporting": F.size("_support"), "external": F.size(organisations), "is_official": rules.source_class(F.col("source"), F.col("url"), F.col("title")) == "official_company"})
    return out.withColumn("unresolved", F.col("total") - F.col("corroborated") - F.col("contradicted")).drop("_ids", "_own", "_support")


def _counted(n: Column, one: str, many: str) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, one).otherwise(many))


def corroboration_label(corroborated: Column, external: Column, official: Column) -> Column:
    both = F.concat(_counted(corroborated, "claim corroborated", "claims corroborated"), F.lit(" · "), _counted(external, "external source", "external sources"))
    alone = F.when(official, "Supported only by the company's own channels").otherwise("Supported only by the same publisher")
    return F.when(corroborated == 0, "No external corroboration found").when(external == 0, alone).otherwise(both)


def contradiction_label(contradicted: Column, total: Column) -> Column:
    """Null without a conflict."""
    return F.when(contradicted > 0, F.format_string("Conflicting evidence on %d of %d claims", contradicted, total))


def evidence_strength(source_class: Column, sources: Column, corroborated: Column) -> Column:
    """Class of the primary, up to three comparison articles and publishers, and a
    bonus for a corroborated claim; at most 1."""
    sources = F.coalesce(sources, F.expr("cast(array() as array<string>)"))
    some = lambda c: F.least(F.size(c), F.lit(3))
    score = maths.mapped(source_class, PRIMARY) + some(sources) * 0.08 + some(F.array_distinct(F.transform(sources, text.casefold))) * 0.04 + F.when(corroborated > 0, 0.15).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def evidence_score(title: Column, at: Column, other: Column, other_at: Column, other_class: Column) -> Column:
    """1, the share of the primary's terms found in the other title, nearness in whole
    days and a bonus for sources of record."""
    mine, theirs = (text.plain_terms(c, EVIDENCE_STOPWORDS) for c in (title, other))
    similar = F.size(F.array_intersect(mine, theirs)) / F.greatest(F.size(mine), F.lit(1))
    near = 1 / (1 + F.abs(maths.floor_days_apart(at, other_at)))
    return 1 + similar + near + F.when(other_class.isin("official_company", "major_financial_news", "regulatory_or_filing"), 0.2).otherwise(0.0)


def public_action(words: Column) -> Column:
    """Supplied text (never a model's own) that shows an authority acting: an
    institution, a regulator by its initials, or a state together with an act."""
    exact = lambda patterns: F.coalesce(words.rlike("|".join(patterns)), F.lit(False))
    state = rules.hit(words, STATES) | exact(STATE_INITIALS)
    return rules.hit(words, INSTITUTIONS) | exact(tuple(rf"\b{x}\b" for x in NAMED_REGULATORS)) | (state & rules.hit(words, STATE_ACTS))


def gated_type(event_type: Column, supplied: Column) -> Column:
    """``regulation`` without a public action in the supplied text becomes ``other``."""
    return F.when((event_type == "regulation") & ~public_action(supplied), "other").otherwise(event_type)


def normalised_holding(events: DataFrame, name: str, symbol: str) -> DataFrame:
    """An event whose own words (summary or a claim text) report an outside holding, in
    an article that does so too (``external``), is of type other and magnitude .1 at most."""
    own = rules.reports_holding(F.col("summary"), name, symbol) | F.exists(F.coalesce("claim_texts", F.expr("cast(array() as array<string>)")), lambda x: rules.reports_holding(x, name, symbol))
    held = F.coalesce(F.col("external"), F.lit(False)) & own
    return events.withColumns({"event_type": F.when(held, "other").otherwise(F.col("event_type")), "magnitude": F.when(held, F.least("magnitude", F.lit(0.1))).otherwise(F.col("magnitude"))})


def mentioned_companies(articles: DataFrame, companies: DataFrame) -> DataFrame:
    """(article_id, symbol) of companies that a text names: by a spelling of the name or
    an alias in whole words, by $SYMBOL or exchange:SYMBOL, or by a bare symbol of three
    letters or more in capitals.

    Articles: article_id, ticker, title, snippet; companies: symbol, name, aliases. The
    article's own ticker never counts. Spellings meet texts on their first word and bare
    symbols on the word itself, so the join is an equi join on words and no pair of an
    article and a company that shares no word is ever formed.
    """
    raw = F.concat_ws(" ", "title", "snippet")
    words = lambda c: F.regexp_extract_all(c, F.lit("([A-Za-z0-9]+)"), F.lit(1))
    said = articles.select("article_id", "ticker", raw.alias("raw")).withColumn("flat", F.concat(F.lit(" "), F.array_join(words(F.lower("raw")), " "), F.lit(" ")))
    said = said.withColumn("word", F.explode(F.array_distinct(words(F.col("raw")))))
    plain = F.regexp_replace(F.trim(F.regexp_replace("name", r"\s*\([^)]*\)$", "")), "(?i)" + rules.REPORT_SUFFIX, "")
    spellings = F.array_union(F.array("name", plain), F.filter(F.coalesce("aliases", F.expr("cast(array() as array<string>)")), lambda x: F.length(x) > 2))
    named = companies.select("symbol", F.explode(spellings).alias("s")).withColumn("phrase", F.array_join(words(F.lower("s")), " ")).where("phrase <> ''")
    named = named.select("symbol", "phrase", F.substring_index("phrase", " ", 1).alias("first")).distinct()
    by_name = said.join(named, F.lower("word") == F.col("first")).where(F.col("flat").contains(F.concat(F.lit(" "), F.col("phrase"), F.lit(" "))))
    symbols = companies.select("symbol").distinct()
    by_symbol = said.join(symbols, F.upper("word") == F.upper("symbol"))
    marked = F.rlike("raw", F.concat(F.lit(r"(?i)(?:\$"), "symbol", F.lit(r"\b|\b(?:nasdaq|nyse|lse)\s*:\s*"), "symbol", F.lit(r"\b)")))
    by_symbol = by_symbol.where(marked | ((F.length("symbol") > 2) & (F.col("word") == F.col("symbol"))))
    own = F.upper("symbol") != F.upper("ticker")
    return by_name.where(own).select("article_id", F.upper("symbol").alias("symbol")).unionByName(by_symbol.where(own).select("article_id", F.upper("symbol").alias("symbol"))).distinct()
