"""Evidence in page text, its coverage, and what pages and statuses come to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.functions import rules
from tarnlake.operators.graph import flatten_chains

# The groups of terms that speak for computer science.
CS_GROUPS = ("computer-science", "software", "data-ai")


def signals(text: Column, patterns: dict[str, str] | None = None) -> dict[str, Column]:
    """One boolean for each category of evidence that the text holds."""
    return {k: F.coalesce(text.rlike("(?i)" + p), F.lit(False)) for k, p in (patterns or rules.EVIDENCE_PATTERNS).items()}


def weighted(text: Column, terms=rules.DISCIPLINE_TERMS) -> Column:
    """The sum of the weights of the terms found as whole words in lower-cased text. A regular expression runs only for terms that occur at all."""
    hits = lambda low: [F.when(F.contains(low, F.lit(t)) & low.rlike(rf"(?<![a-z0-9]){t}(?![a-z0-9])"), w).otherwise(0) for _, t, w in terms]
    return F.element_at(F.transform(F.array(F.lower(text)), lambda low: reduce(lambda a, b: a + b, hits(low))), 1)


def surface_group(text: Column, terms=rules.DISCIPLINE_TERMS) -> Column:
    """Which side the terms found in a text speak for: cs, engineering, both or none."""
    low = F.lower(text)
    side = {True: [], False: []}
    for group, t, _ in terms:
        side[group in CS_GROUPS].append(F.contains(low, F.lit(t)) & low.rlike(rf"(?<![a-z0-9]){t}(?![a-z0-9])"))
    cs, engineering = (F.coalesce(reduce(lambda a, b: a | b, side[k]), F.lit(False)) for k in (True, False))
    return F.when(cs & engineering, "both").when(cs, "cs").when(engineering, "engineering").otherwise("none")


def block_scores(blocks: Column, patterns) -> Column:
    """The sum over blocks of text and (pattern, weight) pairs of the weights of those that occur."""
    return F.aggregate(blocks, F.lit(0), lambda acc, b: acc + reduce(lambda x, y: x + y, (F.when(b.rlike("(?i)" + p), w).otherwise(0) for p, w in patterns)))


def level(score: Column) -> Column:
    return F.when(score >= 12, "strong").when(score >= 5, "moderate").when(score > 0, "weak").otherwise("none")


def first_match(text: Column, ladder, default: str) -> Column:
    """The label of the first pattern found."""
    out = None
    for label, p in ladder:
        out = F.when(text.rlike(p), label) if out is None else out.when(text.rlike(p), label)
    return out.otherwise(default)


def platform(text: Column) -> Column:
    low = F.lower(text)
    out = None
    for name, marks in rules.PLATFORMS:
        hit = reduce(lambda a, b: a | b, (F.contains(low, F.lit(m)) for m in marks))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def captcha(text: Column) -> Column:
    any_case = lambda p: text.rlike("(?i)" + p)
    return any_case(rules.CAPTCHA_GATE) | (any_case(rules.CAPTCHA_WIDGET) & ~any_case(rules.CAPTCHA_INVISIBLE))


def best_status(df: DataFrame, keys: list[str], status: str, precedence: dict[str, int]) -> DataFrame:
    """The status of highest precedence of each key; unknown ones count 0."""
    order = F.coalesce(F.create_map(*(F.lit(x) for p in precedence.items() for x in p))[F.col(status)], F.lit(0))
    return df.groupBy(*keys).agg(F.max_by(status, F.struct(order, F.col(status))).alias(status))


def merged_status(df: DataFrame, keys: list[str], status: str, captcha_flag: str) -> DataFrame:
    """A gate makes a key blocked; else captured, blocked, pending, error, the first that any row has."""
    has = lambda s: F.bool_or(F.col(status) == s)
    return df.groupBy(*keys).agg(F.when(F.bool_or(captcha_flag), "blocked").when(has("captured"), "captured").when(has("blocked"), "blocked").when(has("pending"), "pending").otherwise("error").alias(status))


def coverage(df: DataFrame, keys: list[str], categories: list[str]) -> DataFrame:
    """Per key and category: total, covered, rate to four places (halves to even), any and full."""
    long_ = df.unpivot(keys, categories, "category", "has")
    n, c = F.count("*"), F.count_if("has")
    return long_.groupBy(*keys, "category").agg(n.alias("total"), c.alias("covered"), F.bround(c / n, 4).alias("rate"), F.bool_or("has").alias("has_any"), F.bool_and("has").alias("has_full"))


def climb(pages: DataFrame, page: str, parent: str, stops: DataFrame, stop: str) -> DataFrame:
    """(page, stop): for each page the first of the stop pages on its way up, however long; none for those that reach none or run in a cycle."""
    ends = stops.select(F.col(stop).alias("stop")).distinct()
    up = pages.select(F.col(page).alias("id"), F.col(parent).alias("next"))
    # A chain ends at its first stop; a cycle holds none, so its root is no stop.
    cut = up.join(ends, F.col("id") == F.col("stop"), "left").select("id", F.when(F.col("stop").isNull(), F.col("next")).alias("next"))
    return flatten_chains(cut, "climb").join(ends, F.col("root") == F.col("stop")).select(F.col("id").alias("page"), "stop")
