"""Operator 4: personal data by candidate boosting, with DataFrame functions only.

Generators propose spans: four base patterns, and three wide ones (addresses with written-out marks or other letters, digits
with any grouping, long strings that mix letters and digits). Boosted trees score every candidate from its format and its context.
They learn from what a base rule accepts, from noisy views of it (marks written out, other separators, the words before kept), from
strings that an assignment names as a secret (the name itself is no feature), and from all other candidates as
negatives. A logistic map from held-out candidates calibrates the scores, and a threshold on them adds wide candidates. What a base
rule accepts is always redacted.

Matches are found with ``regexp_extract_all`` and placed with ``split`` by the same pattern: the lengths of the gaps and of the
matches add up to the positions. All patterns run in linear time: repeats are possessive and look behind to their start.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapanel.llm import boosting
from terrapanel.llm.common import stored

KINDS = ["email", "ip", "card", "phone"]
#: The contract's patterns, with possessive repeats and start conditions that change no match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "address": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++\x20?(?:@|[\[(]at[\])])\x20?[\p{L}\p{N}-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[\p{L}\p{N}-]++)++",
    "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])(?=[0-9_+/=-]*+[A-Za-z])[A-Za-z0-9_+/=-]{20,}+",
    "digits": r"(?<![0-9(+])[+(]{0,2}[0-9](?:[\x20().\/-]{0,2}[0-9]){6,}+",
}
CUES = "e-?mail|mail|phone|tel|call|fax|mobile|card|visa|account|address|addr|ip|host|server|contact"
NAMED = r"(?:token|secret|key|passw(?:or)?d|pwd|auth|credential)s?[\"']?\s{0,3}[=:]\s{0,3}[\"']?\z"  # names a string as a secret
CONTEXT = 24  # characters before a candidate that are searched for a cue
CELLS = 100_000  # the features' bins allow fewer combinations than this
PRECISION = 0.95


def _luhn(digits: Column) -> Column:
    """True where the digits pass Luhn's check."""
    figures = F.transform(F.split(F.reverse(digits), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    doubled = F.transform(figures, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _bytes_valid(span: Column) -> Column:
    """True where every dotted number is at most 255."""
    return F.forall(F.split(span, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(256)) <= 255)


def accepted(kind: Column, span: Column) -> Column:
    """Whether a match of a base pattern passes its rule."""
    digits = F.regexp_replace(span, "[^0-9]", "")
    n = F.length(digits)
    return (F.when(kind == "email", F.lit(True)).when(kind == "ip", _bytes_valid(span))
            .when(kind == "card", F.when((n >= 13) & (n <= 19), _luhn(digits)).otherwise(False))
            .when(kind == "phone", (n >= 9) & (n <= 15)).otherwise(False))


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """Array of (kind, i, gap, span, before, after): gap is the length of the text since the last match.

    Spans and gaps are zipped, so that no element's lambda splits the text again.
    """
    spans, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    each = F.arrays_zip(spans.alias("span"), gaps.alias("gap"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("next"))
    return F.transform(F.filter(each, lambda z: z["span"].isNotNull()), lambda z, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(z["gap"]).alias("gap"), z["span"].alias("span"),
        F.lower(F.right(z["gap"], F.lit(CONTEXT))).alias("before"), F.left(z["next"], F.lit(1)).alias("after")))


def candidates(docs: DataFrame) -> DataFrame:
    """(row, doc_id, half, kind, start, end, span, before, after): every candidate in code points, and one row of nulls if a row has none."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), text.alias("text"), F.pmod(F.xxhash64("doc_id", text), F.lit(2)).cast("int").alias("half"))
    found = F.concat(*[F.when(may, _matches(F.col("text"), k, p)).otherwise(F.array().cast(_MATCH)) for k, p, may in (
        *((k, p, _possible(k)) for k, p in BASE.items()), *((k, p, _possible(k)) for k, p in WIDE.items()))])
    each = rows.select("row", "doc_id", "half", F.explode_outer(found).alias("m")).select("row", "doc_id", "half", "m.*")
    each = each.repartition("row")  # the rows of a text together; texts are dealt evenly
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("span")).over(before)
    return each.select("row", "doc_id", "half", "kind", (end - F.length("span")).cast("long").alias("start"), end.cast("long").alias("end"), "span", "before", "after")


_MATCH = "array<struct<kind:string,i:int,gap:int,span:string,before:string,after:string>>"


def _possible(kind: str) -> Column:
    """A cheap test that spares most texts the pattern."""
    text = F.col("text")
    if kind == "email":
        return F.instr(text, "@") > 0
    if kind == "phone":
        return F.instr(text, "+") > 0
    if kind == "address":
        return (F.instr(text, "@") > 0) | text.rlike(r"[\[(]at[\])]")
    if kind == "secret":
        return text.rlike("[A-Za-z0-9_+/=-]{20}")
    return text.rlike("[0-9]")


def views(each: DataFrame) -> DataFrame:
    """Noisy copies of the accepted spans, as wide candidates would see them: what a rule misses but a reader understands."""
    span, email, card = F.col("span"), F.col("kind") == "email", F.col("kind") == "card"
    local, domain = F.substring_index(span, "@", 1), F.substring_index(span, "@", -1)

    def written(at, dot, mark):
        fours = F.regexp_replace(F.regexp_replace(span, "[^0-9]", ""), "([0-9]{4})(?=[0-9])", f"$1{mark}")
        return F.when(email, F.concat(local, F.lit(at), F.regexp_replace(domain, r"\.", dot))).when(card, fours).otherwise(F.regexp_replace(span, r"[\x20-]+", mark))

    spelled, tight = written(" [at] ", " [dot] ", "/"), written("(at)", ".", ".")
    made = each.where("base").where(F.col("kind") != "ip").withColumn("span", F.explode(F.array(spelled, tight)))
    return made.withColumn("kind", F.when(email, "address").otherwise("digits")).withColumn("y", F.lit(1))


def features(c: DataFrame) -> tuple[DataFrame, list[str]]:
    """The candidates with small whole numbers that describe format and context."""
    span = F.col("span")
    digits = F.regexp_replace(span, "[^0-9]", "")
    n = F.length(digits)
    email, secret = F.col("kind").isin("email", "address"), F.col("kind") == "secret"
    mixed = F.length(F.regexp_replace(span, "[^0-9]", "")) * 8 / F.length(span)
    groups = F.size(F.filter(F.split(span, "[^0-9]+"), lambda g: g != ""))
    dotted = span.rlike(r"\A[0-9]+(\.[0-9]+){3}\z")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    made = {
        "f_email": flag(email),
        "f_digits": F.when(email | secret, 0).when(n < 9, 1).when(n < 13, 2).when(n < 16, 3).when(n == 16, 4).when(n < 20, 5).otherwise(6),
        "f_check": F.when(~email & ~secret & (n >= 13) & (n <= 19), flag(_luhn(digits))).otherwise(0),
        "f_bytes": F.when(dotted, F.when(_bytes_valid(span), 2).otherwise(1)).otherwise(0),
        "f_plus": flag(F.startswith(span, F.lit("+"))),
        "f_groups": F.when(email | secret, 0).otherwise(F.least(groups, F.lit(5))),
        "f_written": flag(span.rlike(r"[\[(](at|dot)[\])]|\x20")),
        "f_ending": flag(email & span.rlike(r"\p{L}{2,}\z")),
        "f_cue": flag(F.col("before").rlike(rf"(?:\A|[^a-z])(?:{CUES})[^a-z]{{0,6}}\z")),
        "f_secret": F.when(secret, F.when(F.length(span) < 25, 1).when(F.length(span) < 32, 2).when(F.length(span) < 40, 3).when(F.length(span) < 64, 4).otherwise(5)).otherwise(0),
        "f_mixed": F.when(secret, F.floor(mixed).cast("int")).otherwise(0),
        "f_hex": F.when(secret, flag(span.rlike(r"\A[0-9a-f]+\z"))).otherwise(0),
        "f_quoted": F.when(secret, flag(F.col("before").rlike("[\"'`]\\z"))).otherwise(0),
        "f_joined": flag(F.col("after").rlike(r"[\p{L}\p{N}_]") | F.col("before").rlike(r"[\p{L}\p{N}_]\z")),
    }
    return c.withColumns(made), list(made)


def calibrated(m: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic map from margins to probabilities (Newton steps, lightly held to slope 1)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
        h = w * p * (1 - p)
        grad = np.array([(w * (p - y) * m).sum() + 0.1 * (a - 1), (w * (p - y)).sum() + 0.1 * b])
        hess = np.array([[(h * m * m).sum() + 0.1, (h * m).sum()], [(h * m).sum(), h.sum() + 0.1]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def _threshold(p: np.ndarray, y: np.ndarray, w: np.ndarray, precision: float) -> float:
    """The least calibrated probability of a half or more from which the held-out candidates are positive in a share of ``precision``."""
    out, hits, total = np.inf, 0.0, 0.0
    for s in sorted({float(v) for v in p if v >= 0.5}, reverse=True):
        at = p == s
        hits, total = hits + (w[at] * y[at]).sum(), total + w[at].sum()
        if hits / total >= precision:
            out = s
    return float(out)


def redactions(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """(row, doc_id, kind, start, end, base): the spans chosen; a row of nulls for a text without any."""
    each, names = features(candidates(docs))
    each = each.withColumn("base", F.col("kind").isin(KINDS) & accepted(F.col("kind"), F.col("span")))
    # a wide candidate counts as accepted where its text satisfies a base rule as a whole
    whole = F.lit(False)
    for k, p in BASE.items():
        whole = whole | (F.col("span").rlike(rf"\A(?:{p})\z") & accepted(F.lit(k), F.col("span")))
    named = F.col("before").rlike(NAMED)
    each = stored(each.withColumn("y", F.when(F.col("kind").isin(KINDS), F.col("base")).when(F.col("kind") == "secret", named).otherwise(whole).cast("int")))
    taught = each.where("kind is not null").select("half", "y", *names).unionByName(features(views(each))[0].select("half", "y", *names))
    each = each.drop("before", "after", "half")
    cells = taught.groupBy(*names, "y", "half").agg(F.count(F.lit(1)).alias("w")).limit(CELLS + 1).collect()
    if len(cells) > CELLS:
        raise ValueError("more combinations of features than bins allow")
    cells.sort(key=lambda r: tuple(r))
    x = np.array([[r[n] for n in names] for r in cells], int).reshape(len(cells), len(names))
    y, w, half = (np.array([r[n] for r in cells], float) for n in ("y", "w", "half"))
    fit, test = half == 0, half == 1
    trees = boosting.fit(x[fit], y[fit], w[fit])
    margins = trees.margins(x[test])
    a, b = calibrated(margins, y[test], w[test])
    least = _threshold(1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40))), y[test], w[test], precision)
    score = F.lit(1.0) / (F.exp(-(trees.column([F.col(n) for n in names]) * a + b)) + 1.0)
    n = F.length(F.regexp_replace("span", "[^0-9]", ""))
    named = (F.when(F.col("kind").isin([*KINDS, "secret"]), F.col("kind")).when(F.col("f_email") == 1, "email").when(F.col("f_bytes") > 0, "ip")
             .when((F.col("f_plus") == 1) | (n < 13), "phone").otherwise("card"))
    added = (score >= (least * (1 - 1e-9) if np.isfinite(least) else 2.0)) & ~F.col("kind").isin(KINDS)
    chosen = F.col("kind").isNotNull() & (F.col("base") | added)
    each = each.select("row", "doc_id", named.alias("kind"), "start", "end", "base", chosen.alias("chosen"))
    # an added span must not touch a base span or an added one that starts before it
    order = Window.partitionBy("row").orderBy(F.desc("base"), "start", F.desc("end"), "kind")
    picked = each.where("chosen").withColumn("rank", F.row_number().over(order))
    by_start = Window.partitionBy("row").orderBy("start", F.desc("base"), F.desc("end"), "kind")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(reach, F.lit(0)) <= F.col("start")) & (F.coalesce(ahead, F.col("end")) >= F.col("end"))
    picked = picked.withColumn("free", F.col("base") | free).where("free").select("row", "doc_id", "kind", "start", "end", "base")
    rest = each.where("not chosen").select("row", "doc_id").withColumns(
        {"kind": F.lit(None).cast("string"), "start": F.lit(None).cast("long"), "end": F.lit(None).cast("long"), "base": F.lit(None).cast("boolean")})
    return picked.unionByName(rest)


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, personal (any span) for every row of ``docs``.

    The four counts and base_sha256 describe the base spans, ``spans`` all spans; kinds come in the order above, secrets last, then starts.
    Null and empty texts have none; a null id stays null; repeated rows are searched each; other columns are ignored. Two
    base spans may overlap if their kinds differ. Added spans overlap no other span.
    """
    spans = redactions(docs)
    place = F.array_position(F.array(*map(F.lit, [*KINDS, "secret"])), F.col("kind"))
    mark = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    entry = F.struct(place.alias("k"), "start", "end", mark.alias("mark"))
    lists = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, entry))), lambda e: e.mark)
    got = spans.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), *[F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS],
        lists(F.col("base")).alias("base"), lists(F.col("kind").isNotNull()).alias("all"))
    return got.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(F.concat_ws(",", "base"), 256).alias("base_sha256"),
                      F.concat_ws(",", "all").alias("spans"), (F.size("all") - F.size("base")).cast("long").alias("n_added"), (F.size("all") > 0).alias("personal"))
