"""Numbers: score and rank parsing, rates, priorities, similarity, shards."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def score(c: Column) -> Column:
    """A number from 0 to 100, else null."""
    n = F.trim(c).try_cast("double")
    return F.when(n.between(0, 100), n)


def rank_range(c: Column) -> Column:
    """struct<lower,upper,type> of `12`, `=12`, `601-800`, `601+`; null where it is none of them or upper < lower."""
    s = F.translate(F.trim(c), "–—", "--")
    p = r"^=?(\d+)(?:-(\d+)|(\+))?$"
    low, high = F.regexp_extract(s, p, 1).try_cast("int"), F.regexp_extract(s, p, 2).try_cast("int")
    open_ = F.regexp_extract(s, p, 3) == "+"
    upper = F.when(open_, F.lit(None)).otherwise(F.coalesce(high, low))
    kind = F.when(open_, "openEnded").when(high.isNotNull(), "range").otherwise("exact")
    good = s.rlike(p) & (low >= 1) & (open_ | (F.coalesce(high, low) >= low))
    return F.when(good, F.struct(low.alias("lower"), upper.cast("int").alias("upper"), kind.alias("type")))


def completeness(n: Column, deadlines: Column, requirements: Column, verified: Column) -> Column:
    """0 to 100 in whole numbers: 35 for six programmes, 25 and 25 and 15 for the shares that have each kind of detail."""
    of = F.greatest(n, F.lit(1))
    parts = F.least(n, F.lit(6)) / 6 * 35 + deadlines / of * 25 + requirements / of * 25 + verified / of * 15
    return F.bround(parts).cast("int")


def crawl_priority(first: Column, second: Column, third: Column, sources: Column, best_rank: Column) -> Column:
    """100 or 30, plus 40, plus 30, plus 8 per source, plus what is left of 20 after one for each 25 ranks."""
    bonus = F.greatest(F.lit(0), F.lit(20) - F.floor(best_rank / 25))
    return (F.when(first, 100).otherwise(30) + F.when(second, 40).otherwise(0) + F.when(third, 30).otherwise(0) + 8 * sources + bonus).cast("int")


def rate(covered: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(F.bround(covered / total, 4))


def percent(covered: Column, total: Column) -> Column:
    """Per cent to one place, halves to even; 0 of nothing."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.bround(100 * covered / total, 1))


def shown_percent(share: Column) -> Column:
    """A share as whole per cent text, halves up; `-` for none."""
    return F.coalesce(F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%")), F.lit("-"))


def verified(content: Column, size: Column, digest_: Column) -> Column:
    """Whether bytes have the size and SHA-256 that a manifest gives."""
    return F.coalesce((F.octet_length(content) == size) & (F.sha2(content, 256) == F.lower(digest_)), F.lit(False))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


@pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; the order of the arguments matters."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def shard(key: Column, n: int) -> Column:
    """The first 8 bytes of the key's SHA-256, as an unsigned number, mod n."""
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)"), F.lit(n).cast("decimal(20,0)")).cast("int")


def digest(*parts: Column, length: int = 16) -> Column:
    return F.left(F.sha2(F.concat_ws("\0", *parts), 256), F.lit(length))
