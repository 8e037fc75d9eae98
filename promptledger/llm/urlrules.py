"""URL filters by a bit-parallel wildcard automaton.

All rules are packed into one Shift-And automaton over several 64-bit words: one
bit per pattern state, one mask per byte for the step into the next state and
one for the states a wildcard stays in. A batch of URLs runs through it byte by
byte, all patterns of all URLs at once.

A pattern is matched against ``.host/path``: ``*`` is any run of bytes but ``/``,
``**`` any run at all. Rules of the form (host, path) fit the host with its
subdomains and paths that start with ``path``; the longest fitting rule decides,
and without one the wildcard patterns do: a URL that any of them matches is
blocked. Null URLs and URLs without ``://`` have an empty host and path and are
allowed. Very long URLs run in full.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptledger.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ANY_HOST, ANY = "*", "**"
RULES = (
    ("block", "net", "/"), ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
)
#: Hosts whose names tell what they sell, and paths of feeds.
WILDCARDS = (
    "*casino*", "*casino*/**", "*-bets.*", "*-bets.*/**", "*cheap-*", "*cheap-*/**", "**/feed/**.xml",
)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for null or no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def parse(pattern: str) -> list:
    """Literal bytes and wildcards of a pattern."""
    out: list = []
    for part in re.split(r"(\*\*?)", pattern):
        if part in (ANY_HOST, ANY):
            out.append(part)
        else:
            out.extend(part.encode())
    return out


def rule_tokens(host: str, path: str) -> list:
    return [ANY_HOST, *b".", *host.encode(), *path.encode(), ANY]


@dataclass
class Automaton:
    """Masks of shape (256, words): ``step`` into a state, ``stay`` in it."""

    step: np.ndarray
    stay: np.ndarray
    start: np.ndarray
    accept: list[tuple[int, int]]

    @classmethod
    def of(cls, patterns: list[list]) -> Automaton:
        bits = sum(1 + sum(isinstance(t, int) for t in p) for p in patterns)
        words = bits // 64 + 1
        step, stay = np.zeros((2, 256, words), np.uint64)
        start, accept, at = np.zeros(words, np.uint64), [], 0
        for tokens in patterns:
            start[at // 64] |= np.uint64(1 << at % 64)
            for token in tokens:
                if isinstance(token, int):
                    at += 1
                    step[token, at // 64] |= np.uint64(1 << at % 64)
                else:
                    stay[:, at // 64] |= np.uint64(1 << at % 64)
                    if token == ANY_HOST:
                        stay[ord("/"), at // 64] &= ~np.uint64(1 << at % 64)
            accept.append((at // 64, at % 64))
            at += 1
        return cls(step, stay, start, accept)

    def run(self, texts: list[bytes]) -> np.ndarray:
        """(texts, patterns): whether a pattern matches the whole text."""
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        data = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        begins = np.cumsum(lengths) - lengths
        state = np.tile(self.start, (len(texts), 1))
        alive = np.searchsorted(-lengths, -np.arange(lengths.max(initial=0)), side="left")
        for t, n in enumerate(alive):
            byte = data[begins[:n] + t]
            old = state[:n]
            moved = old << np.uint64(1)
            moved[:, 1:] |= old[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.step[byte]) | (old & self.stay[byte])
        out = np.empty((len(texts), len(self.accept)), bool)
        for p, (word, bit) in enumerate(self.accept):
            out[order, p] = (state[:, word] >> np.uint64(bit)) & np.uint64(1) != 0
        return out


def judge(rules, wildcards):
    """A pandas UDF from ``.host/path`` to a rule's place, -1 for none, -2 for a wildcard's block."""
    by_length = sorted(range(len(rules)), key=lambda i: -len(rules[i][1] + rules[i][2]))
    automaton = Automaton.of([rule_tokens(*rules[i][1:]) for i in by_length] + [parse(w) for w in wildcards])

    @F.pandas_udf("int")
    def place(urls: pd.Series) -> pd.Series:
        if not len(urls):
            return pd.Series([], dtype="int32")
        hits = automaton.run([u.encode("utf-8", "surrogatepass") for u in urls])
        ruled = hits[:, : len(rules)]
        wild = np.where(hits[:, len(rules) :].any(axis=1), -2, -1)
        first = np.asarray(by_length + [0])[ruled.argmax(axis=1)] if len(rules) else 0
        return pd.Series(np.where(ruled.any(axis=1), first, wild).astype("int32"))

    return place


ADDED = ("host", "path", "rule", "verdict")


def judged(df: DataFrame, url: str, rules=RULES, wildcards=WILDCARDS) -> DataFrame:
    """Add host, path, rule and verdict; earlier columns of these names are replaced."""
    host, path = host_path(F.col(url))
    place = judge(rules, wildcards)(F.concat(F.lit("."), host, path))
    names = F.array(*(F.lit(h + p) for _, h, p in rules)).cast("array<string>")
    verdicts = F.array(*(F.lit(v) for v, _, _ in rules)).cast("array<string>")
    own = F.when(F.col("_place") == -2, F.lit("block")).otherwise(F.lit("allow"))
    return (
        df.withColumn("_place", place)
        .select(
            *(F.col(f"`{c}`") for c in df.columns if c not in ADDED), host.alias("host"), path.alias("path"), F.get(names, F.col("_place")).alias("rule"),
            F.coalesce(F.get(verdicts, F.col("_place")), own).alias("verdict"),
        )
    )


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"), "url").drop("url")


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


_LONGEST = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
OP8_SQL = f"""
WITH r AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
d AS (SELECT *, CASE {' '.join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for _, h, p in _LONGEST)} END AS rule FROM h)
SELECT page_id, host, path, rule,
       CASE {' '.join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in RULES)}
            WHEN regexp_matches(host, 'casino|-bets\\.') OR contains(host, 'cheap-') OR regexp_matches(path, '/feed/(?s:.*)\\.xml$') THEN 'block'
            ELSE 'allow' END AS verdict
FROM d
"""
