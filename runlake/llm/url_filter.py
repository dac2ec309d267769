"""Operator 1: URL filters indexed by their rarest literal token.

A rule is a host and a path prefix, or a pattern with ``*``; either becomes one regular
expression. Its literal tokens (runs of ASCII letters and digits that a fitting url
must hold whole) are counted over all urls, and the rule is filed under the rarest.
A url's tokens fetch the rules filed under them, and only those run their expression.

Rules are a list, or a table of any size (``rule_table``). Everything else is DataFrame
work: an equi-join of each url's tokens with the filed rules, in which tokens that no rule is
filed under end before anything is shuffled, and an aggregate of the rules that fit. The
index is a stored table, so Spark knows its size: it broadcasts a small one, and joins a
large one by token, where adaptive execution splits the skewed ones.

Edge cases: a null url, or one without ``://``, has empty host and path; an empty host
fits no host rule; repeated rows keep their own row, repeated rules count once; a rule
without a whole token is filed under the empty token, which urls have only if there is such
a rule; a row of the rule table without host and pattern, or with both, is no rule; no rules
means the default verdict; very long urls are read whole; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlake.llm.common import ROW_ID, identified, stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = "rule string, kind int, weight int, action string, regex string, tokens array<string>"


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text) if text.isascii() else re.escape(text)


def _ends_whole(text: str) -> list[str]:
    """Tokens of ``text`` that something else than a letter or digit follows."""
    return [t.lower() for t in re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", text)]


def host_rule(action: str, host: str, path: str = "/") -> dict:
    """Fits ``host`` and its subdomains where the path starts with ``path`` (empty: any path)."""
    host = host.lower()
    tokens = re.findall("[a-z0-9]+", host) + _ends_whole(path)
    return {"rule": host + path, "kind": 1, "weight": len(host + path), "action": action,
            "regex": rf"^(?:[^/]*\.)?{_quoted(host)}" + (_quoted(path) or "(?:/|$)"), "tokens": tokens}


def pattern_rule(action: str, pattern: str) -> dict:
    """Fits urls that hold ``pattern`` (letters in either case; ``*``: anything)."""
    pattern = pattern.lower()
    tokens = [t for part in pattern.split("*") for t in re.findall(r"(?<=[^a-z0-9])[a-z0-9]+(?=[^a-z0-9])", part)]
    return {"rule": pattern, "kind": 0, "weight": len(pattern), "action": action,
            "regex": ".*".join(map(_quoted, pattern.split("*"))), "tokens": tokens}


def _rules(frames):
    names = [f.split()[0] for f in RULES.split(", ")]
    for frame in frames:
        rules = []
        for action, host, path, pattern in frame.itertuples(index=False):
            if pd.notna(host) and pd.isna(pattern):
                rules.append(host_rule(action, host, path if pd.notna(path) else "/"))
            elif pd.notna(pattern) and pd.isna(host):
                rules.append(pattern_rule(action, pattern))
        yield pd.DataFrame(rules, columns=names)


def rule_table(table: DataFrame) -> DataFrame:
    """Rules for ``judge_urls`` from a table with columns action, host, path (null: ``/``) and
    pattern, of which a row has a host or a pattern."""
    named = table.select(*[F.col(c).cast("string") for c in ("action", "host", "path", "pattern")])
    return named.filter("action is not null").mapInPandas(_rules, RULES)


def _tokens(text: Column) -> Column:
    """Distinct tokens, in lower case."""
    return F.array_distinct(F.split(F.translate(text, _UPPER, _LOWER), "[^a-z0-9]+"))


def url_parts(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return (F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER),
            F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def judge_urls(pages: DataFrame, rules: list[dict] | DataFrame, default: str = "allow",
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: id, host, path, rule (the longest host rule that fits),
    pattern (the longest pattern that fits), verdict."""
    spark = pages.sparkSession
    rows = identified(pages, id_col, url_col)
    host, path = url_parts(F.coalesce(F.col(url_col), F.lit("")))
    rows = rows.select(*ROW_ID, F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
                       host.alias("host"), path.alias("path"))
    if not isinstance(rules, DataFrame):
        names = [f.split()[0] for f in RULES.split(", ")]
        rules = spark.createDataFrame([[r[c] for c in names] for r in rules], RULES)
    rules = stored(rules.distinct(), "url-rules")
    tokens = F.array_remove(_tokens(F.col("url")), "")
    named = rules.select(F.explode("tokens").alias("token")).distinct()
    counts = (rows.select(F.explode(tokens).alias("token")).join(named, "token")
              .groupBy("token").agg(F.count(F.lit(1)).alias("urls")))
    rarest = F.min_by("token", F.struct(F.coalesce("urls", F.lit(0)), "token"))
    index = stored(rules.select("*", F.explode_outer("tokens").alias("token")).join(counts, "token", "left")
                   .groupBy("rule", "kind", "weight", "action", "regex").agg(F.coalesce(rarest, F.lit("")).alias("token")), "url-index")
    if index.filter("token = ''").head(1):
        tokens = F.concat(F.array(F.lit("")), tokens)
    text = F.when(F.col("kind") == 1, F.concat("host", "path")).otherwise(F.translate("url", _UPPER, _LOWER))
    fits = F.regexp_like(text, F.col("regex")) & ((F.col("kind") == 0) | (F.col("host") != ""))
    best = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct("weight", "rule", "action")))
    judged = (rows.withColumn("token", F.explode(tokens)).join(index, "token").filter(fits)
              .groupBy(*ROW_ID).agg(best(1).alias("h"), best(0).alias("p")))
    return rows.join(judged, [*ROW_ID], "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("h.rule").alias("rule"), F.col("p.rule").alias("pattern"),
        F.coalesce("h.action", "p.action", F.lit(default)).alias("verdict"))
