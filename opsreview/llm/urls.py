"""URL filter: rules by host and path, and a weighted vocabulary for all other urls.

The vocabulary is searched with one Aho-Corasick pass over the whole url. A hit counts only
between boundaries: no ASCII letter or digit beside it. A url is blocked if the distinct
terms weigh enough: one strict term, or several distinct soft ones.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRICT = ("casino", "porn", "xxx", "viagra", "escort", "phishing", "malware", "warez", "adult-x", "cheap-pills", "spam-farm")
SOFT = ("adult", "ads", "bets", "bonus", "cheap", "click", "crypto", "deal", "farm", "free", "gambling", "loan", "lottery", "pills", "poker", "prize", "spam", "track", "tracker", "win", "winner")
#: Host and path as the rule gives them, and the verdict.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


@dataclass(frozen=True)
class UrlSettings:
    """A term weighs ``limit`` if strict and 1 if soft; ``limit`` or more blocks."""

    strict: tuple[str, ...] = STRICT
    soft: tuple[str, ...] = SOFT
    limit: int = 2
    rules: tuple[tuple[str, str], ...] = RULES


def _lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def vocabulary_weight(url: Column, settings: UrlSettings) -> Column:
    """Sum of the weights of the distinct terms in a lower-cased url."""
    weights = dict.fromkeys(settings.soft, 1) | dict.fromkeys(settings.strict, settings.limit)

    @F.pandas_udf("int")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        terms = ahocorasick.Automaton()
        for term, weight in weights.items():
            terms.add_word(term, (term, weight))
        terms.make_automaton()
        beside = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
        for urls in batches:
            out = []
            for url in urls:
                found = {}
                for end, (term, weight) in terms.iter(url):
                    start = end - len(term) + 1
                    if (start == 0 or url[start - 1] not in beside) and (end + 1 == len(url) or url[end + 1] not in beside):
                        found[term] = weight
                out.append(sum(found.values()))
            yield pd.Series(out, dtype="int32")

    return weigh(url)


def judged(pages: DataFrame, settings: UrlSettings | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages``, repeated ones too.

    The longest rule that fits decides. A null url, or one without ``://``, has an empty host and path, so
    that no rule fits; a null url has no terms and is allowed.
    """
    settings = settings or UrlSettings()
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    rows = pages.select("page_id", _lowered(F.regexp_extract(url, parts, 1)).alias("host"), F.regexp_extract(url, parts, 2).alias("path"), _lowered(url).alias("url"))
    rule = F.lit(None).cast("string")
    verdict = F.when(F.col("weight") >= settings.limit, "block").otherwise("allow")
    for text, decision in sorted(settings.rules, key=lambda r: (len(r[0]), r[0])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    rows = rows.withColumn("weight", vocabulary_weight(F.col("url"), settings))
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def judged_sql(settings: UrlSettings | None = None) -> str:
    """The same rows in DuckDB's SQL."""
    settings = settings or UrlSettings()
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    cases_rule, cases_verdict = [], []
    for text, decision in sorted(settings.rules, key=lambda r: (-len(r[0]), r[0])):
        host, slash, path = text.partition("/")
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}')"
        cases_rule.append(f"WHEN {fits} THEN '{text}'")
        cases_verdict.append(f"WHEN {fits} THEN '{decision}'")
    weights = dict.fromkeys(settings.soft, 1) | dict.fromkeys(settings.strict, settings.limit)
    hit = "regexp_matches(low, '(^|[^a-z0-9]){}([^a-z0-9]|$)')::INT"
    weight = " + ".join(f"{w} * {hit.format(term)}" for term, w in weights.items())
    return f"""
WITH cut AS (
  SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS low,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{upper}', '{lower}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages)
SELECT page_id, host, path, CASE {' '.join(cases_rule)} ELSE NULL END AS rule,
       CASE {' '.join(cases_verdict)} WHEN {weight} >= {settings.limit} THEN 'block' ELSE 'allow' END AS verdict
FROM cut"""
