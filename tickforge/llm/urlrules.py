r"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over host + path, with literal tokens (runs of a-z, 0-9)
that every URL it fits must hold. The tokens are counted over the URL table and each rule
is filed under its rarest one. A URL's tokens fetch candidate rules; only those run their
regular expressions. Of the fitting rules the longest wins.

Scale: the frequency pass keeps only rule tokens and pre-aggregates, so that its result
is bounded by the rule table. Up to ``INLINE_RULES`` rules the index is a literal in the
plan and URLs are judged without any shuffle. Beyond, rows are written with a number and
joined with the rules by token; a token that more than ``HOT`` URLs hold is split over
parts, and its rules are sent to each. Numbers, not URLs, bring the results back, so that
neither an empty nor a frequent URL fills a task.

Defined results: a null URL or one without ``://`` has empty host and path, no rule (unless
a rule fits the empty string) and the default verdict. Rules without a literal token run on
every URL; without any rule all verdicts are the default. Rows are judged one by one:
repeated rows give repeated results; columns of ``urls`` named like the results give way to
them; empty tables give empty results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.llm.common import written

INLINE_RULES = 500
#: URLs that one task joins with a token's rules, about.
HOT = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    named: bool = True  # reported as the rule; else only its verdict counts, after all named ones


def host_rule(verdict: str, text: str) -> Rule:
    """A rule ``host/path`` for the host and its subdomains and paths that start so.

    A token counts only where it is delimited on both sides, as the path's last may go on.
    """
    tokens = tuple(re.findall(r"[a-z0-9]+(?=[^a-z0-9])", text))
    return Rule(text, r"\A(?:[^/]*\.)?" + re.escape(text), tokens, verdict)


def word_rule(verdict: str, word: str) -> Rule:
    """A rule for URLs that hold a word (of ASCII), delimited, in either case, as tokens are."""
    either = "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else re.escape(c) for c in word)
    return Rule(word, rf"(?:\A|[^A-Za-z0-9]){either}(?:[^A-Za-z0-9]|\z)", tuple(re.findall("[a-z0-9]+", word.lower())), verdict, False)


#: The rules that the query judges by, and what the method blocks besides.
NAMED = (
    host_rule("allow", "org/"),
    host_rule("block", "example.org/es/"),
    host_rule("block", "example.org/en/1"),
    host_rule("allow", "com/fr/"),
    host_rule("block", "com/de/"),
)
WORDS = tuple(
    word_rule("block", w)
    for w in ("adserver", "doubleclick", "casino", "sportsbook", "porn", "xxx-videos", "viagra", "wp-login", "phpmyadmin", "add-to-cart", "checkout-session", "reset-password")
)
RULES = NAMED + WORDS
DEFAULT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.get(F.split(url, "://", 2), F.lit(1))
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: host and path meet at a delimiter, the path's ``/``, or the end."""
    return F.array_distinct(F.split(F.translate(F.concat(host, path), UPPER, LOWER), "[^a-z0-9]+"))


def _text(value: str) -> Column:
    return F.lit(value)


def rarest(urls: DataFrame, rules: tuple[Rule, ...], column: str = "_tokens") -> tuple[list[str | None], dict[str, int]]:
    """For each rule the literal token that fewest URLs hold (ties: longest, then first; None if it has none), and how many hold each."""
    known = sorted({t for r in rules for t in r.tokens})
    if not known:
        return [None] * len(rules), {}
    hits = urls.select(F.explode(F.array_intersect(column, F.array(*map(_text, known)))).alias("token"))
    seen = dict(map(tuple, hits.groupBy("token").count().collect()))  # at most the rules' tokens
    return [min(r.tokens, key=lambda t: (seen.get(t, 0), -len(t), t), default=None) for r in rules], seen


def _order(rule: Rule) -> int:
    """Which fitting rule wins: named before others, longer before shorter."""
    return (1 << 20 if rule.named else 0) + len(rule.name)


def _entry(rule: Rule) -> Column:
    return F.struct(
        F.lit(_order(rule)).alias("rank"),
        F.lit(rule.name if rule.named else None).cast("string").alias("name"),
        F.lit(rule.verdict).alias("verdict"),
        F.lit(rule.pattern).alias("pattern"),
    )


def _best(fits: Column) -> Column:
    return F.array_max(F.transform(fits, lambda r: F.struct(r["rank"].alias("rank"), r["name"].alias("name"), r["verdict"].alias("verdict"))))


def _joined(cut: DataFrame, filed: dict[str, list[Rule]], seen: dict[str, int]) -> DataFrame:
    """``cut`` with _filed, the best of the rules filed under its tokens, by joins."""
    rows = [(t, _order(r), r.name if r.named else None, r.verdict, r.pattern) for t, rs in filed.items() for r in rs]
    index = cut.sparkSession.createDataFrame(rows, "token string, rank int, name string, verdict string, pattern string")
    # hot tokens are few: no more than the tokens of all URLs over HOT
    hot = {t: -(-seen[t] // HOT) for t in filed if seen.get(t, 0) > HOT}
    parts = F.lit(1)
    if hot:
        parts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in sorted(hot.items()) for x in pair]), F.col("token")), F.lit(1))
    index = index.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    numbered = written(cut.withColumn("_row", F.monotonically_increasing_id()), "urls")
    asked = numbered.select("_row", F.concat("_host", "_path").alias("_subject"), F.explode("_tokens").alias("token"))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("_row"), parts).cast("int"))
    found = asked.join(index, ["token", "part"]).filter(F.rlike("_subject", F.col("pattern")))
    best = found.groupBy("_row").agg(F.max(F.struct("rank", "name", "verdict")).alias("_filed"))
    return numbered.join(best, "_row", "left")


def judge(urls: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", inline: int = INLINE_RULES) -> DataFrame:
    """``urls`` with host, path, rule and verdict."""
    kept = [F.col(f"`{c}`") for c in urls.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(urls[url])
    cut = urls.select(F.struct(*kept).alias("_kept"), host.alias("_host"), path.alias("_path"))  # one struct: no name can clash
    cut = cut.withColumn("_tokens", tokens(F.col("_host"), F.col("_path")))
    subject = F.concat("_host", "_path")
    fits = lambda r: F.rlike(subject, r["pattern"])
    best = F.lit(None).cast("struct<rank:int,name:string,verdict:string>")
    filed: dict[str | None, list[Rule]] = {}
    names, seen = rarest(cut, rules)
    for token, rule in zip(names, rules, strict=True):
        filed.setdefault(token, []).append(rule)
    everywhere = filed.pop(None, [])
    if everywhere:
        best = _best(F.filter(F.array(*map(_entry, everywhere)), fits))
    if len(rules) <= inline:
        if filed:
            index = F.create_map(*[x for t, rs in sorted(filed.items()) for x in (F.lit(t), F.array(*map(_entry, rs)))])
            known = F.array_intersect("_tokens", F.array(*map(_text, sorted(filed))))
            found = F.flatten(F.transform(known, lambda t: F.element_at(index, t)))
            best = _best(F.filter(F.concat(found, F.array(*map(_entry, everywhere))) if everywhere else found, fits))
    elif filed:
        cut = _joined(cut, filed, seen)
        best = F.array_max(F.array("_filed", best))  # nulls are passed over
    out = cut.withColumn("_best", best)
    return out.select(
        "_kept.*",
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_best.name").alias("rule"),
        F.coalesce("_best.verdict", F.lit(DEFAULT)).alias("verdict"),
    )
