"""URL filters: pattern rules indexed by their rarest literal token.

A rule names the literal tokens that any matching URL must hold. The index files each rule under
the one of its tokens that is rarest among the URLs; a URL's own tokens fetch the candidate rules,
and only those run their regular expression. Of the matching rules the one with the highest rank
decides (ties: the first given).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """pattern runs (re.search) on host, `#` (which neither part can hold), and path; tokens are literals that each match must hold."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int
    shown: bool = True


def prefix_rule(action: str, rule: str) -> Rule:
    """`host/path`: holds for the host, its subdomains, and paths that start with the given path."""
    host, slash, path = rule.partition("/")
    host = host.lower()
    pattern = r"\A(?:[^#]*\.)?" + re.escape(f"{host}#{slash}{path}")
    whole = path[: path.rfind("/") + 1]  # the last piece of a path may be part of a longer token
    return Rule(rule, action, pattern, tuple(dict.fromkeys(TOKEN.findall(host) + TOKEN.findall(whole.lower()))), len(host) + len(path) + 1)


def word_rule(action: str, word: str) -> Rule:
    """Blocks or allows URLs that hold all pieces of `word` side by side, as whole tokens."""
    pieces = TOKEN.findall(word.lower())
    pattern = r"(?i)(?<![a-z0-9])" + r"[^a-z0-9/#]".join(map(re.escape, pieces)) + r"(?![a-z0-9])"
    return Rule(word, action, pattern, tuple(pieces), 0, shown=False)


#: The four rules of the stated list.
SITE_RULES = (
    prefix_rule("block", "net/"),
    prefix_rule("allow", "example.net/en/"),
    prefix_rule("block", "example.com/de/"),
    prefix_rule("allow", "org/fr/"),
)

#: Names of gambling, adult and malware sites, blocked where no site rule decides.
WORD_RULES = tuple(
    word_rule("block", w)
    for w in (
        "free-bets", "casino", "poker", "slots", "betting", "jackpot", "gambling", "lottery",
        "porn", "xxx", "adult", "sex", "nude", "escort", "camgirls", "hentai",
        "cheap-pills", "viagra", "cialis", "payday-loan", "warez", "crack", "keygen", "torrent", "phishing", "malware",
    )
)

#: An argument list of rules is sent to every task, so it is held to this many.
MAX_RULES = 200_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; path: then up to `?` or `#`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def token_frequencies(urls: DataFrame, rules: Sequence[Rule]) -> dict[str, int]:
    """How many URLs hold each token that some rule could be filed under; counted over all URLs."""
    wanted = sorted({t for r in rules for t in r.tokens})
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.concat("host", "path")), F.lit("([a-z0-9]+)"), 1))
    kept = F.array_intersect(tokens, F.array(*map(F.lit, wanted))) if len(wanted) <= 500 else tokens
    counts = urls.select(F.explode(kept).alias("t")).groupBy("t").count()
    if len(wanted) > 500:
        counts = counts.join(urls.sparkSession.createDataFrame([(t,) for t in wanted], "t string"), "t", "left_semi")
    return {r.t: r["count"] for r in counts.collect()}  # at most one row for each token of a rule


def judge(urls: DataFrame, rules: Sequence[Rule] = SITE_RULES + WORD_RULES, default: str = "allow") -> DataFrame:
    """urls with host, path, rule, verdict added.

    A rule table may hold any number of rules up to MAX_RULES; each url runs only those filed under one of its tokens.
    Needs a column `url`; the four new names replace columns of the same name. A null URL or one
    without `://` has an empty host and path, so no rule holds: rule null, verdict `default`.
    Repeated rows are each judged. Without rules every verdict is `default`. A rule without a
    literal token is tried on every URL."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES}")
    host, path = host_and_path(F.col("url"))
    split = urls.drop("host", "path", "rule", "verdict").withColumn("host", host).withColumn("path", path)
    seen = token_frequencies(split, rules) if any(r.tokens for r in rules) else {}
    index: dict[str, list[int]] = {}
    for k, r in enumerate(rules):
        index.setdefault(min(r.tokens, key=lambda t: (seen.get(t, 0), -len(t), t)) if r.tokens else "", []).append(k)
    told = [(r.pattern, r.rank, r.name if r.shown else None, r.action) for r in rules]
    schema = split.schema
    out_schema = split.withColumn("rule", F.lit("").cast("string")).withColumn("verdict", F.lit("").cast("string")).schema
    for name in ("rule", "verdict"):
        out_schema[name].nullable = True
    h, p = schema.names.index("host"), schema.names.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict[int, re.Pattern] = {}
        for batch in batches:
            names, verdicts = [], []
            for host, path in zip(batch.column(h).to_pylist(), batch.column(p).to_pylist(), strict=True):
                both = f"{host}#{path}"
                best = None
                if host or path:
                    for token in {"", *TOKEN.findall(both.lower())}:
                        for k in index.get(token, ()):
                            if best is not None and (told[k][1], -k) < best:
                                continue
                            if k not in compiled:
                                compiled[k] = re.compile(told[k][0])
                            if compiled[k].search(both):
                                best = (told[k][1], -k)
                names.append(told[-best[1]][2] if best else None)
                verdicts.append(told[-best[1]][3] if best else default)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(verdicts, pa.string())],
                names=[*schema.names, "rule", "verdict"],
            )

    return split.mapInArrow(run, out_schema)
