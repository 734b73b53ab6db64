"""URL filters: pattern rules found through an index of their rarest literal token.

A rule is a host with a path beginning (``example.com/en/``; it fits the host and its subdomains), or a pattern with ``*`` for
any characters over host and path (``*-pills.*``).  Each rule has literal tokens (runs of letters and digits) that every
URL it fits must contain whole.  Token frequencies are counted over all URLs at hand, and a rule is filed under its rarest
token.  A URL's own tokens fetch the candidates, and regular expressions run on those only.

Up to ``LITERAL_RULES`` rules are a literal of the plan: everything is a column expression on the row, and nothing is shuffled but
the token counts (one row per token of a rule).  A longer list becomes a table that the tokens of distinct URLs are joined with;
the results are the same.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LITERAL_RULES = 2_000
ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    text: str

    @property
    def is_pattern(self) -> bool:
        return "*" in self.text

    def regex(self) -> str:
        """Over host and path written together."""
        if self.is_pattern:
            return "(?s)^" + ".*".join(_quoted(p) for p in self.text.split("*")) + "$"
        host, slash, path = self.text.partition("/")
        return f"^(?:[^/]*\\.)?{_quoted(host)}{_quoted(slash + path)}" + ("" if slash else "(?:/|$)")

    def tokens(self) -> list[str]:
        """Literal tokens that a URL holds as whole tokens wherever the rule fits."""
        # A token at an open end of a piece may go on in the URL.
        text = self.text if self.is_pattern else self.text + ("*" if "/" in self.text else "/")
        return [m[0].lower() for m in re.finditer(r"[A-Za-z0-9]+", text) if text[m.start() - 1:m.start()] != "*"
                and text[m.end():m.end() + 1] != "*"]


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", text)


# Rules of the method where no host rule fits: kinds of hosts and paths that carry no articles.
PATTERNS = tuple(Rule(BLOCK, text) for text in (
    "*-pills.*", "*.pills.*", "*/pills/*", "*spam-farm.*", "*-casino.*", "*.casino.*", "*/casino/*", "*-poker.*", "*/poker/*",
    "*-loans.*", "*.porn.*", "*/porn/*", "*.xxx/*", "*-escorts.*", "*/phishing/*", "*/malware/*"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased.  Path: from there up to ``?``, ``#`` or the
    end.  Both are empty for NULL and where there is no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.split(F.translate(F.concat(host, path), UPPER, LOWER), "[^a-z0-9]+"))


def token_counts(urls: DataFrame, rules: Sequence[Rule], url: str = "url") -> dict[str, int]:
    """In how many URLs each literal token of the rules occurs; tokens that occur in none are left out."""
    wanted = sorted({t for rule in rules for t in rule.tokens()})
    if not wanted:
        return {}
    found = urls.select(F.explode(F.filter(_tokens(*host_and_path(F.col(url).cast("string"))), lambda t: t.isin(wanted))).alias("token"))
    return {row[0]: row[1] for row in found.groupBy("token").count().collect()}


def rarest(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str | None, list[Rule]]:
    """Rules by their rarest token; under None those without one, which are candidates for every URL."""
    index: dict[str | None, list[Rule]] = {}
    for rule in rules:
        token = min(rule.tokens(), key=lambda t: (counts.get(t, 0), t), default=None)
        index.setdefault(token, []).append(rule)
    return index


def _entries(rules: Sequence[Rule]) -> Column:
    return F.array(*[F.struct(F.lit(not r.is_pattern).alias("is_host"), F.lit(len(r.text)).alias("size"), F.lit(r.text).alias("text"),
                              F.lit(r.verdict).alias("verdict"), F.lit(r.regex()).alias("regex")) for r in rules])


def judged(urls: DataFrame, host_rules: Sequence[Rule], patterns: Sequence[Rule] = PATTERNS, url: str = "url") -> DataFrame:
    """Add host, path, rule, verdict and pattern to every row; columns of these names are replaced, others kept.

    ``rule``: the longest host rule that fits (of equally long ones the last by text), else NULL; ``verdict`` is its verdict.
    Where none fits, ``pattern`` is the longest pattern that fits and gives the verdict, else the verdict is allow.
    """
    rules = [*host_rules, *patterns]
    out = urls.drop("host", "path", "rule", "verdict", "pattern") if url not in ("host", "path", "rule") else urls
    host, path = host_and_path(F.col(url).cast("string"))
    if len(rules) > LITERAL_RULES:
        return _judged_by_table(out.select("*", host.alias("host"), path.alias("path")), rules)
    index = rarest(rules, token_counts(urls, rules, url))
    always = index.pop(None, [])
    candidates = _entries(always) if always else None
    if index:
        keys = list(index)
        filed = F.create_map(*[c for key in keys for c in (F.lit(key), _entries(index[key]))])
        fetched = F.flatten(F.transform(F.filter(_tokens(F.col("host"), F.col("path")), lambda t: t.isin(keys)),
                                        lambda t: F.element_at(filed, t)))
        candidates = F.concat(fetched, candidates) if candidates is not None else fetched
    # Behind a generator, so that the expression runs once for all columns made of it.
    located = out.select("*", host.alias("host"), path.alias("path"))
    if candidates is None:
        none = F.lit(None).cast("string")
        return located.select("*", none.alias("rule"), F.lit(ALLOW).alias("verdict"), none.alias("pattern"))
    fits = F.filter(candidates, lambda r: F.rlike(F.concat("host", "path"), r["regex"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["is_host"], r["size"], r["text"], r["verdict"])))
    chosen = located.select("*", F.explode(F.array(best)).alias("_best"))
    is_host = F.col("_best.is_host")
    return chosen.select(
        *located.columns, F.when(is_host, F.col("_best.text")).alias("rule"),
        F.coalesce("_best.verdict", F.lit(ALLOW)).alias("verdict"), F.when(~is_host, F.col("_best.text")).alias("pattern"))


def rule_table(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(is_host, size, text, verdict, regex, token): rules with their rarest literal token over distinct (host, path); a NULL token
    where a rule has none."""
    rows = [(not r.is_pattern, len(r.text), r.text, r.verdict, r.regex(), sorted(set(r.tokens()))) for r in dict.fromkeys(rules)]
    table = urls.sparkSession.createDataFrame(
        rows, "is_host boolean, size int, text string, verdict string, regex string, tokens array<string>")
    held = table.select(F.explode("tokens").alias("token")).distinct()
    counts = urls.select(F.explode(_tokens(F.col("host"), F.col("path"))).alias("token")).join(held, "token", "left_semi").groupBy(
        "token").agg(F.count(F.lit(1)).alias("n"))
    plain = ["is_host", "size", "text", "verdict", "regex"]
    each = table.select(*plain, F.explode_outer("tokens").alias("token")).join(counts, "token", "left")
    return each.groupBy(*plain).agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))


def _judged_by_table(located: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``judged`` for rules of any number.  Equal URLs are judged once; a URL meets only the rules filed under its tokens."""
    places = located.select("host", "path").distinct()
    table = rule_table(places, rules)
    tokens = places.select("host", "path", F.explode(_tokens(F.col("host"), F.col("path"))).alias("token"))
    met = tokens.join(table.where("token IS NOT NULL"), "token").drop("token")
    # Rules without a token are few and fit any URL.
    always = [r for r in dict.fromkeys(rules) if not r.tokens()]
    if always:
        met = met.unionByName(places.select("host", "path", F.inline(_entries(always))))
    fits = met.where(F.rlike(F.concat("host", "path"), F.col("regex"))).groupBy("host", "path").agg(
        F.max(F.struct("is_host", "size", "text", "verdict")).alias("_best"))
    joined = located.join(fits.withColumnsRenamed({"host": "_host", "path": "_path"}),
                          (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    is_host = F.col("_best.is_host")
    return joined.select(
        *located.columns, F.when(is_host, F.col("_best.text")).alias("rule"),
        F.coalesce("_best.verdict", F.lit(ALLOW)).alias("verdict"), F.when(~is_host, F.col("_best.text")).alias("pattern"))
