"""URL filters: rules indexed by their rarest literal token, with DataFrame operations alone.

A rule is a regular expression over host and path, with the literal tokens (runs of a-z and 0-9 between other characters) that
every address it fits must have. It is indexed under the one that the fewest of the addresses at hand have. Each distinct
address fetches the rules under its tokens, and only those run their expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .names import free_name, moved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Site rules of the query: host and path, verdict.
SITE_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Words that block an address no site rule fits, wherever they stand in it as a token.
BLOCKED_TOKENS = ("casino", "pills", "porn", "spam", "viagra")


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def tokens_of(text: Column) -> Column:
    """Distinct literal tokens, and the empty one under which rules without tokens are found."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(lowered(text), "[^a-z0-9]+")))


def site_rule(rule: str, verdict: str) -> tuple[str, str, list[str], str, int]:
    """A rule ``host/path`` for the host and its subdomains and for paths that start with its own; longer rules win."""
    host, _, path = rule.partition("/")
    literal = re.findall("[a-z0-9]+", host.lower()) + re.findall("[a-z0-9]+(?=[^a-z0-9])", ("/" + path).lower())
    return rule, rf"(?s)^(?:[^/]*\.)?\Q{host}/{path}\E", literal, verdict, len(rule)


def token_rule(word: str, verdict: str) -> tuple[str, str, list[str], str, int]:
    """A rule for addresses that have the word as a token; any site rule wins."""
    return f"*{word}*", rf"(?is)(?:^|[^a-z0-9])\Q{word}\E(?:[^a-z0-9]|$)", [word], verdict, 0


def rule_table(spark: SparkSession, rules: list[tuple[str, str, list[str], str, int]]) -> DataFrame:
    """(rule, pattern, literals, verdict, weight) rows; large rule sets are read from a table of these columns instead."""
    text = lambda x: "r'" + x + "'"
    rows = ", ".join(f"({text(rule)}, {text(pattern)}, array({', '.join(map(text, literal))}), {text(verdict)}, {weight})" for rule, pattern, literal, verdict, weight in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(rule, pattern, literals, verdict, weight)")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for a null or one without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    tail = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return lowered(F.regexp_extract(tail, "(?s)^([^/?#]*)", 1)), F.regexp_extract(tail, "(?s)^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``__host``, ``__path``, ``__rule``, ``__weight`` and ``__verdict``; columns that it has of these names stay with
    further underscores before them.

    Of the rules that fit, the one of greatest weight wins, the first in order of its text among equals; with none the rule is
    null and the verdict ``default``. Null urls and those without ``://`` have an empty address, which rules may fit too.
    Repeated rows are judged alike; an empty table stays empty; an empty rule table leaves all to the default.

    Addresses are judged once each and joined back, so a page that a third of the rows repeat is one. Where the rules are few
    Spark sends them to the executors by its own size check, and shuffles both sides on the token otherwise.
    """
    host, path = split_url(F.col(url_col))
    pages = moved(pages, "__host", "__path", "__rule", "__weight", "__verdict")
    won = free_name(pages, "best")
    keyed = pages.withColumns({"__host": host, "__path": path})
    addresses = keyed.select("__host", "__path").distinct().withColumn("address", F.concat("__host", "__path"))
    words = addresses.select("address", "__host", "__path", F.explode(tokens_of(F.col("address"))).alias("token"))
    literals = rules.select("rule", "pattern", "verdict", "weight", F.explode(F.when(F.size("literals") > 0, F.transform("literals", lowered)).otherwise(F.array(F.lit("")))).alias("token"))
    seen = words.join(literals.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    # a rule of which a token is in no address fits none
    whole = rules.select("rule", "pattern", "verdict", "weight", F.greatest(F.size(F.array_distinct(F.transform("literals", lowered))), F.lit(1)).alias("all"))
    distinct = literals.distinct().join(seen, "token").groupBy("rule", "pattern", "verdict", "weight").agg(F.count("*").alias("held"), F.min(F.struct("n", "token")).alias("rarest"))
    index = distinct.join(whole, ["rule", "pattern", "verdict", "weight"]).where("held = all").select("rule", "pattern", "verdict", "weight", F.col("rarest.token").alias("token"))
    fits = words.join(index, "token").where(F.rlike("address", F.col("pattern")))
    best = fits.groupBy("__host", "__path").agg(F.min(F.struct((-F.col("weight")).alias("order"), "rule", "verdict")).alias(won))
    joined = keyed.join(best, ["__host", "__path"], "left")
    return joined.withColumns({"__rule": F.col(f"{won}.rule"), "__weight": -F.col(f"{won}.order"), "__verdict": F.coalesce(f"{won}.verdict", F.lit(default))}).drop(won)
