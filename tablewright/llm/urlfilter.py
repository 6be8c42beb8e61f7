"""URL verdicts by rules and, where none fits, by logistic regression on hashed character n-grams.

DataFrame functions only. The labelled table is small: a bounded sample of distinct urls that a rule decides. The
model is fitted by full-batch gradient steps, each one an aggregation by feature, and its weights are one array of fixed
length that every row looks up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import SAMPLE_BUCKETS, cut

#: (verdict, host, path): fixed values.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
BUCKETS = 2048
SIZES = (3, 4)
SAMPLE = 4_000
ROUNDS = 12
STEP = 2.0
DECAY = 1e-4


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, else null."""
    found = None
    for verdict, name, start in sorted(rules, key=lambda x: -len(x[1] + x[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        value = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def features(host: Column, path: Column, buckets: int = BUCKETS, sizes: tuple[int, ...] = SIZES) -> Column:
    """Distinct hashed n-grams of the host and of the path, with marks at their ends."""

    def grams(text: Column, kind: str, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(kind), F.substr(text, i, F.lit(n))), F.lit(buckets)).cast("int"))

    parts = [grams(F.concat(F.lit("^"), text, F.lit("$")), kind, n) for text, kind in ((host, "host"), (path, "path")) for n in sizes]
    return F.array_distinct(F.concat(*parts))


def _weights(values: list[float]) -> Column:
    return F.split(F.lit(",".join(f"{x:.9g}" for x in values)), ",").cast("array<double>")


def probability(found: Column, weights: list[float]) -> Column:
    """P(block) of feature sets; the last weight is the bias. Features are scaled to unit length."""
    table = _weights(weights[:-1])
    total = F.aggregate(found, F.lit(0.0), lambda s, f: s + F.get(table, f))
    return 1 / (1 + F.exp(-(total / F.sqrt(F.size(found).cast("double")) + F.lit(float(weights[-1])))))


def fit(labelled: DataFrame, buckets: int = BUCKETS, rounds: int = ROUNDS, step: float = STEP, decay: float = DECAY) -> list[float]:
    """Weights from rows (found array<int>, target 0/1). Both classes weigh the same; with one class, the bias alone.

    A round returns at most ``buckets`` sums to the driver.
    """
    rows = cut(labelled.select("found", F.col("target").cast("double").alias("target")))
    counts = {int(r["target"]): r["count"] for r in rows.groupBy("target").count().collect()}
    weights = [0.0] * (buckets + 1)
    if len(counts) < 2:
        weights[-1] = -3.0 if not counts or 0 in counts else 3.0
        return weights
    share = F.when(F.col("target") == 1, 0.5 / counts[1]).otherwise(0.5 / counts[0])
    speed = [0.0] * (buckets + 1)
    for _ in range(rounds):
        miss = (probability(F.col("found"), weights) - F.col("target")) * share
        each = rows.select("found", miss.alias("miss"))
        spread = F.explode(F.concat("found", F.array(F.lit(buckets)))).alias("f")
        value = F.when(F.col("f") == buckets, F.col("miss")).otherwise(F.col("miss") / F.col("norm"))
        sums = each.select(spread, "miss", F.sqrt(F.size("found").cast("double")).alias("norm")).groupBy("f").agg(F.sum(value).alias("g"))
        slope = {r["f"]: r["g"] for r in sums.collect()}
        for f in range(buckets + 1):
            g = slope.get(f, 0.0) + (decay * weights[f] if f < buckets else 0.0)
            speed[f] = 0.9 * speed[f] - step * g
            weights[f] += speed[f]
            if not math.isfinite(weights[f]):
                raise ArithmeticError("the step is too large")
    return weights


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, sample: int = SAMPLE, buckets: int = BUCKETS) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block for every row of ``pages`` (page_id, url).

    Null urls and urls without ``://`` have empty host and path and get the model's verdict for these. The model is
    fitted on ``sample`` of the distinct urls that a rule decides, half of each verdict, those of least hash; copies count
    once. Without any, it allows. Repeated rows get the same answer each; an empty table gives no rows; other columns aren't read.
    """
    # the parts are named in a select of their own, so that they are worked out once
    split = pages.select(pages["page_id"].alias("page_id"), host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    known = split.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("told"))
    decided = known.where("told is not null").select("host", "path", (F.col("told.verdict") == "block").cast("int").alias("target"))
    told = decided.withColumn("h", F.xxhash64(F.lit(1), F.concat("host", F.lit("\n"), "path")))
    counts = {r["target"]: r["n"] for r in told.groupBy("target").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    picked = []
    for target, n in sorted(counts.items()):
        # half as many again as wanted, since the count is an estimate; then copies go and the least hashes stay
        drawn = told.where((F.col("target") == target) & (F.pmod("h", F.lit(SAMPLE_BUCKETS)) < F.lit(int(min(1.0, 0.75 * sample / n) * SAMPLE_BUCKETS))))
        picked.append(drawn.groupBy("host", "path", "h").agg(F.max("target").alias("target")).orderBy(F.pmod("h", F.lit(SAMPLE_BUCKETS)), "h").limit(sample // 2))
    if picked:
        distinct = picked[0] if len(picked) == 1 else picked[0].unionAll(picked[1])
        weights = fit(distinct.select(features(F.col("host"), F.col("path"), buckets).alias("found"), "target"), buckets)
    else:
        weights = [0.0] * buckets + [-3.0]
    scored = known.withColumn("p_block", F.when(F.col("told").isNull(), probability(features(F.col("host"), F.col("path"), buckets), weights)))
    verdict = F.coalesce(F.col("told.verdict"), F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("told.rule").alias("rule"), verdict.alias("verdict"), "p_block")


__all__ = ["RULES", "features", "fit", "host_of", "judge_urls", "path_of", "probability", "rule_of"]
