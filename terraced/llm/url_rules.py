"""URL filters: pattern rules found through their rarest literal token.

A rule is a regular expression with the literal tokens that every matching URL
holds; one that matches in several ways has such tokens for each way. Over the whole table
the pages of each rule token are counted, and each way of a rule is indexed by its rarest token. A URL's tokens fetch the rules indexed by them, and
only those run their expressions. The four host rules are such rules as well: their
expression is matched with host and path, the longest one that fits wins, and only
where none fits do the general patterns decide, an allowing one before a blocking
one. A page that nothing matches is allowed.

Host rules fit a host and its subdomains when the path begins with the rule's path.
Tokens are runs of a-z and 0-9 after lower-casing A-Z. A run at the end of a host rule's path may go on in a
URL, so it is not a token of the rule. A rule, or a way of it, without any token can't be indexed and runs on every
page. Rules may share a name; each is one of its own, and of host rules of one name the blocking one wins.

Defined results. A null url, or one without ``://``, has an empty host and path and
is allowed. Repeated rows stay rows. Only page_id and url are read. An empty table
gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraced.llm.common import pin

_ANY = ""  # stands for the token of rules that have none
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str  # for host and path if from a host rule, else for the lower-cased url
    tokens: tuple[str, ...]
    is_host: bool = False
    others: tuple[tuple[str, ...], ...] = ()  # tokens of the pattern's further ways to match

    @property
    def ways(self) -> tuple[tuple[str, ...], ...]:
        return (self.tokens, *self.others)


def host_rule(verdict: str, name: str) -> Rule:
    """A rule such as ``example.net/en/``: host with subdomains, path prefix."""
    tokens = tuple(re.findall("[a-z0-9]+(?=[^a-z0-9])", name.lower()))
    return Rule(name, verdict, "^(?:[^/]*\\.)?" + re.escape(name), tokens, True)


HOST_RULES = (
    host_rule("block", "net/"),
    host_rule("allow", "example.net/en/"),
    host_rule("block", "example.com/de/"),
    host_rule("allow", "org/fr/"),
)

PATTERNS = (
    Rule("ad-tracker", "block", "://[^/?#]*\\bads-track\\.", ("ads", "track")),
    Rule("ad-server", "block", "://(?:[^/?#]*\\.)?adserver\\.", ("adserver",)),
    Rule("casino", "block", "://[^/?#]*\\bcasino\\b", ("casino",)),
    Rule("betting", "block", "://[^/?#]*\\bsports-?bet\\b|://[^/?#]*\\bbet\\b", ("bet",), others=(("sportsbet",),)),
    Rule("adult-host", "block", "://[^/?#]*\\bxxx\\b", ("xxx",)),
    Rule("adult-path", "block", "/adult/", ("adult",)),
    Rule("login-page", "block", "/wp-login\\.php(?:[?#]|$)", ("wp", "login", "php")),
    Rule("script-folder", "block", "/cgi-bin/", ("cgi", "bin")),
    Rule("cart", "block", "/cart/(?:add|checkout)\\b", ("cart",)),
    Rule("calendar-trap", "block", "/calendar/\\d{4}/\\d{1,2}/\\d{1,2}/", ("calendar",)),
    Rule("session", "block", "[?&;]phpsessid=", ("phpsessid",)),
    Rule("program", "block", "\\.exe(?:[?#]|$)", ("exe",)),
    Rule("encyclopedia", "allow", "://(?:[^/?#]*\\.)?encyclopedia\\.", ("encyclopedia",)),
)


def _lower(column: Column) -> Column:
    return F.translate(column, _UPPER, _UPPER.lower())


def with_parts(pages: DataFrame) -> DataFrame:
    at = F.instr(F.coalesce("url", F.lit("")), "://")
    rest = F.when(at > 0, F.substring(F.col("url"), at + 3, F.length("url"))).otherwise(F.lit(""))
    return (
        pages.withColumn("_rest", rest)
        .withColumn("host", _lower(F.regexp_extract("_rest", "^[^/?#]*", 0)))
        .withColumn("path", F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1))
        .drop("_rest")
    )


def judge(pages: DataFrame, *, host_rules: tuple[Rule, ...] = HOST_RULES, patterns: tuple[Rule, ...] = PATTERNS) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``pattern`` (the deciding general rule) for every row."""
    spark = pages.sparkSession
    read = with_parts(pages.select("page_id", F.col("url").cast("string").alias("url"))).withColumn("_row", F.monotonically_increasing_id())
    words = F.array_distinct(F.split(_lower(F.coalesce("url", F.lit(""))), "[^a-z0-9]+"))
    rows = pin(read.withColumn("_tokens", words), "url-rows")

    rules = (*host_rules, *patterns)
    known = sorted({t for r in rules for way in r.ways for t in way})
    held = rows.select(F.explode(F.array_intersect("_tokens", F.array(*map(F.lit, known)).cast("array<string>"))).alias("token"))
    pages_of = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}  # rule tokens only
    index = [
        (min(way, key=lambda t: (pages_of.get(t, 0), t), default=_ANY), r.name, r.verdict, r.pattern, r.is_host) for r in rules for way in r.ways
    ]
    indexed = spark.createDataFrame(index, "token string, name string, does string, pattern string, is_host boolean")

    asked = F.array_remove("_tokens", _ANY)
    if any(entry[0] == _ANY for entry in index):
        asked = F.array_append(asked, _ANY)
    fetched = rows.select("_row", "host", "path", "url", F.explode(asked).alias("token")).join(indexed, "token")
    subject = F.when(F.col("is_host"), F.concat("host", "path")).otherwise(_lower(F.col("url")))
    fits = fetched.filter(F.regexp_like(subject, F.col("pattern")))
    best = fits.groupBy("_row").agg(
        F.max(F.when(F.col("is_host"), F.struct(F.length("name").alias("l"), "name", "does"))).alias("h"),
        F.min(F.when(~F.col("is_host"), F.struct("does", "name"))).alias("p"),
    )
    found = rows.join(best, "_row", "left")
    return found.select(
        "page_id",
        "host",
        "path",
        F.col("h.name").alias("rule"),
        F.coalesce("h.does", "p.does", F.lit("allow")).alias("verdict"),
        F.when(F.col("h").isNull(), F.col("p.name")).alias("pattern"),
    )
