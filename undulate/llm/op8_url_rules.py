"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over `host + path` with literal tokens that every fitting URL must hold. Each rule is
filed under the one of its tokens that the fewest URLs hold, counted over all pages; where an expression has alternatives,
one token stands for each (`p:click|p:track`: a fitting URL holds at least one), and the rule is filed under all of them.
The tokens of a URL fetch the rules filed under them, and only those run their expression. Everything is DataFrame functions.

Repeated URLs are judged once. A null URL, or one without `://`, has an empty host and path, fits nothing and gets the
default verdict. Extra columns of the pages are ignored; repeated rows stay rows of their own; an empty table gives none.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from undulate.llm.common import ascii_lower

#: Rule tables up to this many rows are broadcast; longer ones are joined by a shuffle.
BROADCAST_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    """name: as reported; verdict: allow or block; regex over host + path; tokens: `h:` of the host, `p:` of the path; those of alternatives joined by `|`."""

    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    size: int
    listed: bool


def listed_rule(host: str, path: str, verdict: str) -> Rule:
    """A host with all its subdomains, and a prefix of the path."""
    literal = lambda s: re.sub(r"([^A-Za-z0-9/])", r"\\\1", s)
    whole = path if not path[-1:].isalnum() else re.sub(r"[A-Za-z0-9]+$", "", path)  # the last token may go on in the URL
    tokens = [f"h:{t}" for t in re.split("[^a-z0-9]+", host) if t] + [f"p:{t}" for t in re.split("[^A-Za-z0-9]+", whole) if t]
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{literal(host)}{literal(path)}", tuple(tokens), len(host + path), True)


def pattern_rule(name: str, verdict: str, regex: str, *tokens: str) -> Rule:
    """A free expression with the literal tokens that it needs."""
    return Rule(name, verdict, regex, tokens, len(regex), False)


RULES = (
    listed_rule("net", "/", "block"),
    listed_rule("example.net", "/en/", "allow"),
    listed_rule("example.com", "/de/", "block"),
    listed_rule("org", "/fr/", "allow"),
    pattern_rule("spam host", "block", r"^(?:[^/]*[.-])?spam-[^/]*", "h:spam"),
    pattern_rule("tracker path", "block", r"^[^/]*/(?:[^/]*/)*(?:click|track)/", "p:click|p:track"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_tokens(host: Column, path: Column) -> Column:
    of = lambda c, pattern, kind: F.transform(F.split(c, pattern), lambda t: F.concat(F.lit(kind), t))
    return F.array_distinct(F.concat(of(host, "[^a-z0-9]+", "h:"), of(path, "[^A-Za-z0-9]+", "p:")))


def rarest_token_index(urls: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """One row a rule and alternative: the tokens that the fewest URLs hold (no URL: none of them can fit), and the rule beside each."""
    schema = T.StructType([T.StructField(n, t) for n, t in (
        ("need", T.StringType()), ("token", T.StringType()), ("name", T.StringType()), ("verdict", T.StringType()), ("regex", T.StringType()),
        ("size", T.IntegerType()), ("listed", T.BooleanType()))])
    spark = urls.sparkSession
    filed = spark.createDataFrame([(need, t, r.name, r.verdict, r.regex, r.size, r.listed) for r in rules for need in r.tokens for t in need.split("|")], schema)
    held = small(filed.select("token").distinct(), rules)
    counts = (urls.select(F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
              .join(held, "token").groupBy("token").agg(F.count("*").alias("n")))
    needs = (filed.join(counts, "token", "left").groupBy("name", "regex", "need")
             .agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.min("verdict").alias("verdict"), F.min("size").alias("size"), F.min("listed").alias("listed")))
    first = needs.groupBy("name", "regex").agg(F.min(F.struct("n", "need", "verdict", "size", "listed")).alias("r"))
    return first.select("name", "regex", F.explode(F.split("r.need", "[|]")).alias("token"), "r.verdict", "r.size", "r.listed")


def small(rule_rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    return F.broadcast(rule_rows) if sum(len(r.tokens) for r in rules) <= BROADCAST_RULES else rule_rows


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule, pattern, verdict of every row.

    The longest fitting listed rule decides; where none fits, the longest fitting pattern rule; else `default`.
    """
    if any(not r.tokens for r in rules):
        raise ValueError("a rule without a literal token can't be indexed")
    host, path = host_and_path(F.col("url"))
    urls = pages.select("url").where(F.col("url").isNotNull()).distinct().select("url", host.alias("host"), path.alias("path"))
    index = rarest_token_index(urls, rules)
    candidates = (urls.select("url", F.concat("host", "path").alias("address"), F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
                  .join(small(index, rules), "token"))
    best = (candidates.where(F.expr("address rlike regex"))
            .groupBy("url").agg(F.max(F.struct("listed", "size", "verdict", "name")).alias("best")))
    found = best.select("url", F.when(F.col("best.listed"), F.col("best.name")).alias("rule"),
                        F.when(~F.col("best.listed"), F.col("best.name")).alias("pattern"), F.col("best.verdict").alias("verdict"))
    return (pages.select("page_id", "url", host.alias("host"), path.alias("path")).join(found, "url", "left")
            .select("page_id", "url", "host", "path", "rule", "pattern", F.coalesce("verdict", F.lit(default)).alias("verdict")))
