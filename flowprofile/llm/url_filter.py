"""URL filter: host and path rules first, then a weighted vocabulary searched with Aho-Corasick.

Every URL is one row of one narrow scan: no shuffle, no state beyond the two parameter lists (rules and terms).

* Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: on from there up to `?`, `#` or the end.
  A null URL, or one without `://`, has an empty host and path.
* Rules: `host/path` prefixes. A rule fits its host and all subdomains if the path starts with the rule's path. The longest
  fitting rule decides; of equally long ones the first given.
* Vocabulary: terms are searched in the whole URL, A-Z lower-cased. A hit counts only between boundaries: neither neighbour is
  a letter a-z or a digit. One strict hit, or `soft_needed` distinct soft terms, reject the URL; the rest is allowed.
  A null or empty URL has no hits and is allowed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Vocabulary of the default filter: one strict term rejects; soft terms reject together.
STRICT_TERMS = ("adult", "casino", "escort", "gambling", "hentai", "porn", "sex", "viagra", "warez", "xxx")
SOFT_TERMS = (
    "ads", "bet", "bets", "bonus", "cam", "cheap", "crack", "dating", "farm", "free", "hot", "jackpot", "keygen", "loan", "nude",
    "pills", "poker", "slots", "spam", "torrent", "track", "win",
)
SOFT_NEEDED = 2
#: (prefix, verdict) of the query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

_OUTPUT = "rule string, rule_verdict string, strict_hits int, soft_hits int"
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_LOWER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def automaton(strict: Sequence[str], soft: Sequence[str]) -> ahocorasick.Automaton | None:
    """Terms with their weight class; a term given as both is strict. None if there are no terms."""
    machine = ahocorasick.Automaton()
    for term in soft:
        machine.add_word(term, (term, False))
    for term in strict:
        machine.add_word(term, (term, True))
    if not len(machine):
        return None
    machine.make_automaton()
    return machine


def count_terms(url: str, machine: ahocorasick.Automaton | None) -> tuple[int, int]:
    """Strict hits and distinct soft terms between boundaries; `url` is lower-cased."""
    strict, soft = 0, set()
    if machine is None or not url:
        return 0, 0
    for end, (term, is_strict) in machine.iter(url):
        start = end - len(term) + 1
        if (start and url[start - 1] in _ALNUM) or (end + 1 < len(url) and url[end + 1] in _ALNUM):
            continue
        if is_strict:
            strict += 1
        else:
            soft.add(term)
    return strict, len(soft)


def fitting_rule(host: str, path: str, rules: dict[str, list[tuple[str, str, str]]]) -> tuple[str | None, str | None]:
    """The longest rule that fits; `rules` has (path, rule, verdict) by host."""
    best: tuple[str | None, str | None] = (None, None)
    at = 0
    while rules:
        for rule_path, rule, verdict in rules.get(host[at:], ()):
            if path.startswith(rule_path) and (best[0] is None or len(rule) > len(best[0])):
                best = (rule, verdict)
        dot = host.find(".", at)
        if dot < 0:
            break
        at = dot + 1
    return best


def judge_urls(
    pages: DataFrame, *, url: str = "url", keep: Sequence[str] = ("page_id",), rules: Sequence[tuple[str, str]] = RULES,
    strict: Sequence[str] = STRICT_TERMS, soft: Sequence[str] = SOFT_TERMS, soft_needed: int = SOFT_NEEDED,
) -> DataFrame:
    """The columns `keep`, then host, path, rule, verdict, strict_hits and soft_hits; one row per input row.

    Other columns are dropped, whatever their names. Repeated rows are judged alike; an empty table gives no rows.
    """
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in rules:
        host, slash, path = rule.partition("/")
        by_host.setdefault(host, []).append((slash + path, rule, verdict))

    @F.pandas_udf(_OUTPUT)
    def judged(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        machine = automaton(strict, soft)
        for urls, hosts, paths in batches:
            rows = [
                (*fitting_rule(h, p, by_host), *count_terms(u.translate(_LOWER), machine))
                for u, h, p in zip(urls, hosts, paths, strict=True)
            ]
            yield pd.DataFrame(rows, columns=["rule", "rule_verdict", "strict_hits", "soft_hits"])

    whole = F.coalesce(F.col(url), F.lit(""))
    after = F.expr("CASE WHEN instr(_u, '://') > 0 THEN substring(_u, instr(_u, '://') + 3) ELSE '' END")
    parts = (
        pages.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), whole.alias("_u"))
        .withColumn("_after", after)
        .withColumn("_host", F.regexp_extract("_after", r"^([^/?#]*)", 1))
        .withColumn("_path", F.expr("regexp_extract(substring(_after, length(_host) + 1), '^([^?#]*)', 1)"))
        .withColumn("_host", F.translate("_host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        .withColumn("_j", judged("_u", "_host", "_path"))
    )
    rejected = (F.col("_j.strict_hits") >= 1) | (F.col("_j.soft_hits") >= soft_needed)
    return parts.select(
        "_row.*", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_j.rule").alias("rule"),
        F.coalesce(F.col("_j.rule_verdict"), F.when(rejected, "block").otherwise("allow")).alias("verdict"),
        F.col("_j.strict_hits").alias("strict_hits"), F.col("_j.soft_hits").alias("soft_hits"),
    )


def verdict_sql() -> str:
    """DuckDB SQL of the query: the same rules and vocabulary as regular expressions over the URL."""
    bounded = "regexp_matches(u, '(^|[^a-z0-9])({})([^a-z0-9]|$)')"
    soft = " + ".join(f"CAST({bounded.format(t)} AS INTEGER)" for t in SOFT_TERMS)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def fits(rule: str) -> str:
        host, slash, path = rule.partition("/")
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + path}')"

    longest = sorted(RULES, key=lambda r: -len(r[0]))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in longest)
    verdict = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES)
    return f"""
WITH cut AS (
  SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS u,
    CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS after FROM pages),
hosts AS (SELECT *, regexp_extract(after, '^([^/?#]*)', 1) AS raw FROM cut),
parts AS (
  SELECT page_id, u, translate(raw, '{upper}', '{lower}') AS host, regexp_extract(substr(after, length(raw) + 1), '^([^?#]*)', 1) AS path FROM hosts),
ruled AS (SELECT *, CASE {rule} END AS rule, {soft} AS soft_hits,
    len(regexp_extract_all(regexp_replace(u, '([^a-z0-9])', '\\1\\1', 'g'), '(^|[^a-z0-9])({"|".join(STRICT_TERMS)})([^a-z0-9]|$)')) AS strict_hits FROM parts)
SELECT page_id, host, path, rule,
  CASE {verdict} WHEN strict_hits >= 1 OR soft_hits >= {SOFT_NEEDED} THEN 'block' ELSE 'allow' END AS verdict,
  CAST(strict_hits AS INTEGER) AS strict_hits, CAST(soft_hits AS INTEGER) AS soft_hits
FROM ruled"""
