"""URL filters: pattern rules indexed by their rarest literal token.

Each rule is a regular expression with the literal tokens that any matching
url must hold.  One pass counts, over the whole table, the urls that hold each
rule token; a rule is filed under its rarest one.  A url then looks up its own
tokens in that index and only the rules found run their expression.

The index is a small array of buckets, addressed by a token's hash, inside the
plan: no join, no shuffle and no Python, and a hot host costs its own rows only.
Its size is that of the rule list, which is checked (`MAX_RULES`); a longer list
goes through an equi-join on the token instead, with the same results.

Cases: a null url, or one without ``://``, has empty host and path and matches
no rule; repeated urls and rows are judged alike; an empty table gives an empty
result; columns of the input other than the url are kept as they are, those
named like an output column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

MAX_RULES = 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """name: what is reported; pattern: Java regex, searched in host + path;
    tokens: literal runs of [a-z0-9] that stand alone in every match (lower-case);
    rank: the largest rank of the matching rules wins, then the smaller name."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def host_rule(verdict: str, host: str, path: str = "/") -> Rule:
    """A rule for host, its subdomains and paths that start with path; longer ones win."""
    host = host.translate(str.maketrans(UPPER, LOWER))
    ends = path if re.search(r"[^A-Za-z0-9]$", path) else re.sub(r"[A-Za-z0-9]+$", "", path)
    tokens = tuple(re.findall(r"[a-z0-9]+", f"{host}{ends}".lower()))
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{_quote(host + path)}", tokens, 1000 + len(host + path))


def word_rule(verdict: str, *words: str) -> Rule:
    """A rule for urls whose host holds the words one after another, joined by - or a dot."""
    return Rule("-".join(words), verdict, r"^[^/]*(?<![a-z0-9])" + "[-.]".join(map(_quote, words)) + r"(?![a-z0-9])", words, len("-".join(words)))


def _quote(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", s)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    both = lambda n: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", n), F.lit(""))
    return F.translate(both(1), UPPER, LOWER), both(2)


def _tokens(host: Column, path: Column) -> Column:
    text = F.translate(F.concat(host, path), UPPER, LOWER)
    return F.array_distinct(F.regexp_extract_all(text, F.lit("([a-z0-9]+)"), 1))


def rarest_tokens(tokens: DataFrame, rules: Sequence[Rule]) -> dict[Rule, str]:
    """Each rule's token that the fewest rows hold. tokens: one array column `_tokens`.

    Only tokens of rules are counted, so the result is as small as the rule list.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    hit = tokens.select(F.explode(F.array_intersect("_tokens", F.array(*map(F.lit, wanted)))).alias("token"))
    seen = {r["token"]: r["n"] for r in hit.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return {r: min(r.tokens, key=lambda t: (seen.get(t, 0), t)) for r in rules}


def judge(df: DataFrame, url: str, rules: Sequence[Rule], default: str = "allow", max_rules: int = MAX_RULES) -> DataFrame:
    """df with host, path, rule (null where none matches) and verdict."""
    if bad := [r.name for r in rules if not r.tokens]:
        raise ValueError(f"rules without a literal token: {bad}")
    host, path = parts(F.col(url))
    keep = [c for c in df.columns if c not in {"host", "path", "rule", "verdict"}]
    base = df.select(*[F.col(f"`{c}`") for c in keep], host.alias("host"), path.alias("path"))
    base = base.withColumn("_tokens", _tokens(F.col("host"), F.col("path")))
    if not rules:
        return base.drop("_tokens").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    filed = rarest_tokens(base.select("_tokens"), rules)
    found = _by_join(base, filed) if len(rules) > max_rules else base.withColumn("_best", _best(_inline(filed)))
    return found.withColumn("rule", F.col("_best.name")).withColumn("verdict", F.coalesce(F.col("_best.verdict"), F.lit(default))).drop("_tokens", "_best")


def _entry(rule: Rule, token: str) -> Column:
    one = {"token": F.lit(token), "rank": F.lit(rule.rank), "name": F.lit(rule.name), "verdict": F.lit(rule.verdict), "pattern": F.lit(rule.pattern)}
    return F.struct(*[v.alias(k) for k, v in one.items()])


def _inline(filed: dict[Rule, str]) -> Column:
    """The candidates of a row: entries of the index under one of its tokens."""
    by_token: dict[str, list[Column]] = {}
    for r, t in sorted(filed.items(), key=lambda x: x[0].name):
        by_token.setdefault(t, []).append(_entry(r, t))
    n = 1 << max(0, len(by_token) - 1).bit_length()
    buckets: list[list[Column]] = [[] for _ in range(n)]
    for t, entries in by_token.items():
        buckets[_bucket(t, n)] += entries
    empty = F.filter(F.array(next(iter(by_token.values()))[0]), lambda _: F.lit(False))
    index = F.array(*[F.array(*b) if b else empty for b in buckets])
    slot = lambda t: (F.crc32(t.cast("binary")) % n + 1).cast("int")
    return F.flatten(F.transform("_tokens", lambda t: F.filter(F.element_at(index, slot(t)), lambda e: e["token"] == t)))


def _bucket(token: str, n: int) -> int:
    import zlib

    return zlib.crc32(token.encode()) % n


def _best(candidates: Column) -> Column:
    """The winning candidate among those whose expression matches host + path."""
    text = F.concat("host", "path")
    hits = F.transform(F.filter(candidates, lambda e: F.regexp_like(text, e["pattern"])), _ranked)
    return F.array_min(hits)


def _ranked(e: Column) -> Column:
    return F.struct((-e["rank"]).alias("order"), e["name"].alias("name"), e["verdict"].alias("verdict"))


def _by_join(base: DataFrame, filed: dict[Rule, str]) -> DataFrame:
    """The same over an equi-join on the token, for rule lists of any length.

    Judged once for each distinct host and path, so a hot url meets the join once.
    """
    spark = base.sparkSession
    index = spark.createDataFrame([(t, r.rank, r.name, r.verdict, r.pattern) for r, t in filed.items()], "token string, rank int, name string, verdict string, pattern string")
    urls = base.select("host", "path", F.explode("_tokens").alias("token")).distinct()
    hit = urls.join(index, "token").where(F.regexp_like(F.concat("host", "path"), F.col("pattern")))
    best = hit.groupBy("host", "path").agg(F.min(F.struct((-F.col("rank")).alias("order"), "name", "verdict")).alias("_best"))
    return base.join(best, ["host", "path"], "left")
