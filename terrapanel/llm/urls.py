"""Operator 5: URL filter. Rules decide where one fits; boosted trees on lexical features decide elsewhere.

The trees learn from the URLs that a rule has labelled. Features are lengths, depth, digit share, entropy, counts of
parameters and marks, and how often labelled URLs of the same host suffix (last label, last two labels) are blocked.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.llm import boosting
from terrapanel.llm.common import hashed_sample, stored

ALLOW, BLOCK = "allow", "block"
SAMPLE = 20_000  # labelled URLs that the trees are fitted on, drawn by a hash of id and URL
BINS = 32


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(verdict: str, text: str) -> Rule:
    """A rule such as ``example.org/en/1``: a host, then a path prefix from the first slash."""
    host, slash, rest = text.partition("/")
    return Rule(verdict, host, slash + rest)


RULES = [parse_rule(*r) for r in ((ALLOW, "org/"), (BLOCK, "example.org/es/"), (BLOCK, "example.org/en/1"), (ALLOW, "com/fr/"), (BLOCK, "com/de/"))]


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) by position: both empty for a null URL or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; nulls if none does. Equal lengths: the later rule."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Numbers read off the URL's characters."""
    u = F.coalesce(url, F.lit(""))
    n = F.length(u)
    chars = F.array_distinct(F.split(u, ""))
    counts = F.transform(chars, lambda c: F.when(c == "", 0).otherwise(n - F.length(F.replace(u, c, F.lit("")))).cast("double"))
    spread = F.aggregate(counts, F.lit(0.0), lambda a, c: a + F.when(c > 0, c * F.log2(c)).otherwise(0.0))
    return {
        "length": n.cast("double"), "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda s: s != "")).cast("double"),
        "labels": F.size(F.split(host, r"\.")).cast("double"),
        "digit_share": (n - F.length(F.regexp_replace(u, "[0-9]", ""))) / F.greatest(n, F.lit(1)),
        "entropy": F.when(n > 0, F.log2(F.greatest(n, F.lit(1))) - spread / F.greatest(n, F.lit(1))).otherwise(0.0),
        "parameters": F.when(F.instr(u, "?") > 0, F.size(F.split(u, "[?&]")) - 1).otherwise(0).cast("double"),
        "marks": (n - F.length(F.regexp_replace(u, "[-_%~#=]", ""))).cast("double"),
        "secure": F.startswith(u, F.lit("https")).cast("double"),
    }


def _suffixes(host: Column) -> dict[str, Column]:
    labels = F.split(host, r"\.")
    last = F.element_at(labels, -1)
    two = F.when(F.size(labels) > 1, F.concat_ws(".", F.element_at(labels, -2), last)).otherwise(last)
    return {"last": last, "two": two}


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many cuts lie below the value."""
    out = F.lit(0)
    for k, c in enumerate(cuts):
        out = F.when(value > c, k + 1).otherwise(out)
    return out


def judge(pages: DataFrame, rules: list[Rule] = RULES, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' block_probability (null where a rule decides) for every row.

    A null URL and one without ``://`` have an empty host and path; no rule fits them. If no rule has labelled any URL, or all
    with one verdict, the trees return the share of blocked ones (0.5 without labels); 0.5 and more blocks. Repeated rows are
    judged each and null ids kept; other columns are ignored. Suffix statistics count all labelled rows; the trees are
    fitted on at most ``sample`` of the labelled rows, those with the smallest hashes of id and URL.
    """
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    numbers = lexical(F.col("url"), F.col("host"), F.col("path"))
    ends = _suffixes(F.col("host"))
    rows = stored(rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("fixed"), F.xxhash64("page_id", "url").alias("order"),
                              *[c.alias(f"x_{n}") for n, c in numbers.items()], *[c.alias(f"end_{n}") for n, c in ends.items()]))
    blocked = (F.col("fixed") == BLOCK).cast("double")
    prior, labelled = rows.agg(F.avg(blocked), F.count("fixed")).first()
    prior = 0.5 if prior is None else prior
    for n in ends:
        rate = rows.where("fixed is not null").groupBy(f"end_{n}").agg(F.count(F.lit(1)).alias(f"seen_{n}"), F.sum(blocked).alias(f"hits_{n}"))
        rows = rows.join(stored(rate), f"end_{n}", "left")
    own = F.col("fixed").isNotNull().cast("int")  # a labelled URL doesn't count in its own statistics
    names = [f"x_{n}" for n in numbers]
    for n in ends:
        seen, hits = F.coalesce(f"seen_{n}", F.lit(0)) - own, F.coalesce(f"hits_{n}", F.lit(0.0)) - F.coalesce(blocked, F.lit(0.0))
        rows = rows.withColumn(f"x_rate_{n}", (hits + prior) / (seen + 1))
        names.append(f"x_rate_{n}")
    rows = stored(rows.select("page_id", "host", "path", "rule", "fixed", "order", *names))
    taught = hashed_sample(rows.where("fixed is not null"), "order", labelled, sample).select(*names, blocked.alias("y")).toPandas()
    x, y = taught[names].to_numpy("float64"), taught["y"].to_numpy("float64")
    cuts = [sorted({float(c) for c in np.quantile(v, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")}) if len(v) else [] for v in x.T]
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1) if len(x) else np.zeros((0, len(names)), int)
    trees = boosting.fit(bins, y, np.ones(len(y)))
    binned = [_bin(F.col(n), c) for n, c in zip(names, cuts, strict=True)]
    rows = rows.select("page_id", "host", "path", "rule", "fixed", *[b.alias(f"b{k}") for k, b in enumerate(binned)])
    margin = trees.column([F.col(f"b{k}") for k in range(len(names))])
    p = F.when(F.col("fixed").isNull(), 1 / (1 + F.exp(-margin)))
    rows = rows.select("page_id", "host", "path", "rule", "fixed", p.alias("block_probability"))
    decided = F.when(F.col("block_probability") >= 0.5, BLOCK).otherwise(ALLOW)
    return rows.select("page_id", "host", "path", "rule", F.coalesce("fixed", decided).alias("verdict"), "block_probability")
