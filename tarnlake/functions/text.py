"""Text functions: Column to Column. Folding to ASCII and HTML entities need pandas UDFs, all else is native."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tarnlake.functions import rules


def _null_safe(f):
    return lambda s: s.map(lambda v: None if v is None else f(v))


@pandas_udf(T.StringType())
def fold_ascii(s: pd.Series) -> pd.Series:
    """NFKD, then whatever is not ASCII dropped."""
    return _null_safe(lambda v: unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode())(s)


@pandas_udf(T.StringType())
def strip_marks(s: pd.Series) -> pd.Series:
    """NFKD without combining marks; other letters stay."""
    return _null_safe(lambda v: "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)))(s)


@pandas_udf(T.StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    return _null_safe(html.unescape)(s)


@pandas_udf(T.StringType())
def repair_mojibake(s: pd.Series) -> pd.Series:
    """UTF-8 that was read as Windows-1252 put right, up to three times while that lessens the tell-tale characters."""
    signs = "ÃÂâ€�"
    count = lambda v: sum(v.count(c) for c in signs)

    def fix(v):
        for _ in range(3):
            try:
                better = v.encode("cp1252").decode("utf-8")
            except UnicodeError:
                return v
            if count(better) >= count(v):
                return v
            v = better
        return v

    return _null_safe(fix)(s)


def ascii_only(plain: Column, folded) -> Column:
    """plain where it is ASCII already, else what folded (a pandas UDF) makes of it; Python sees only the other values."""
    return F.when(plain.rlike(r"^\p{ASCII}*$"), plain).otherwise(folded(F.when(~plain.rlike(r"^\p{ASCII}*$"), plain)))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def slug(c: Column) -> Column:
    """Unicode letters stay; runs of space and hyphen become one underscore."""
    kept = F.regexp_replace(c, r"(?U)[^\w\s-]", "")
    return F.concat(F.lit("u_"), F.lower(F.regexp_replace(F.regexp_replace(kept, r"[\s\-]+", "_"), "^_+|_+$", "")))


def short_slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.left(s, F.lit(40)), F.lit("")), F.lit("prog"))


def name_key(c: Column) -> Column:
    """The key by which boards' institution names are compared; c is unescaped and folded already."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "&", " and "), "--", " ")
    s = F.regexp_replace(s, r"\s*\([^)]*\)\s*", " ")
    s = F.regexp_replace(s, r"\s+-\s+(?:china|mainland china)$", " ")
    s = F.regexp_replace(s, r"[^\w\s]", " ")
    s = F.regexp_replace(s, r"\b(" + "|".join(rules.NAME_STOP_WORDS) + r")\b", " ")
    return squeeze(s)


def alias_key(c: Column) -> Column:
    """Abbreviations spelt out, leading article dropped; c is folded already."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"\binst\.", "institute"), r"\buniv\.", "university")
    return F.regexp_replace(F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")), "^the ", "")


def token_key(c: Column) -> Column:
    """[a-z0-9]+ tokens joined by spaces, parentheses kept; c is without marks already."""
    return F.array_join(F.regexp_extract_all(F.regexp_replace(F.lower(c), "&", " and "), F.lit("([a-z0-9]+)"), 1), " ")


def live_key(c: Column) -> Column:
    """As token_key, with letters of all scripts."""
    return F.array_join(F.regexp_extract_all(F.regexp_replace(F.lower(c), "&", " and "), F.lit(r"([\p{L}\p{N}]+)"), 1), " ")


def compact_key(c: Column) -> Column:
    return F.regexp_replace(live_key(c), " ", "")


def site_key(c: Column) -> Column:
    """As name_key without the steps for `&`, dashes and tails, and with `college` kept; c is without marks already."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"\s*\(.*?\)\s*", " "), r"[^\w\s]", " ")
    return squeeze(F.regexp_replace(s, r"\b(" + "|".join(w for w in rules.NAME_STOP_WORDS if w != "college") + r")\b", " "))


def report_key(c: Column) -> Column:
    """As name_key, parentheses dropped before `&` is spelt out; c is folded already."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), r"\([^)]*\)", " "), "&", " and ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\b(" + "|".join(rules.NAME_STOP_WORDS) + r")\b", " "), "[^a-z0-9]+", " "))


def coverage_key(c: Column) -> Column:
    """site_key with the digraphs of umlauts as single letters."""
    return F.replace(F.replace(F.replace(site_key(c), F.lit("ae"), F.lit("a")), F.lit("oe"), F.lit("o")), F.lit("ue"), F.lit("u"))


def canonical_slug(c: Column) -> Column:
    return F.concat(F.lit("u_"), F.replace(token_key(c), F.lit(" "), F.lit("_")))


def term_fold(c: Column) -> Column:
    """How navigation labels are compared; c is without marks already."""
    return F.lower(squeeze(F.replace(F.replace(c, F.lit("’"), F.lit("'")), F.lit("-"), F.lit(" "))))


def country_key(c: Column) -> Column:
    return squeeze(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("’"), F.lit("'")))


def semantic_tokens(c: Column) -> Column:
    """Sorted distinct tokens of a name without articles and kinds of institutions, place names and common words in English; c is without marks already."""
    words = F.filter(F.split(token_key(c), " "), lambda t: (F.length(t) > 1) & ~t.isin(*rules.TOKEN_STOP_WORDS))
    return F.array_sort(F.array_distinct(F.transform(words, lambda t: F.coalesce(mapped(t, rules.TOKEN_TRANSLATIONS), t))))


def query_variants(name: Column, country: Column) -> Column:
    """array<struct<name,transformation>> of safe other forms to look a name up by: without a short acronym in parentheses, without what follows a `|`, without the country at the end.

    Words that tell institutions apart stay, in parentheses, too.
    """
    words = "|".join(rules.PROTECTED_QUALIFIERS)
    acronym = rf"\s*\((?=[^()]*[A-Z])(?!(?i:(?:[^()]*\W)?(?:{words})(?:\W[^()]*)?\)))(?=(?:[^A-Za-z()]*[A-Za-z0-9]){{1,12}}[^A-Za-z0-9()]*\))(?:[^()\sa-z]+(?:\s+[^()\sa-z]+){{0,2}})\)\s*"
    plain = squeeze(F.regexp_replace(name, acronym, " "))
    before = F.regexp_replace(squeeze(F.element_at(F.split(name, r"\|", 2), 1)), "^[ ,;/-]+|[ ,;/-]+$", "")
    place = squeeze(F.coalesce(country, F.lit("")))
    low, tail = F.lower(F.rtrim(name)), F.lower(place)
    cut = lambda end: F.rtrim(F.left(F.rtrim(name), F.length(F.rtrim(name)) - F.length(end)))
    ends = [(F.concat(F.lit("("), tail, F.lit(")")), r"$"), (tail, r",$"), (tail, r"\s[-–—]$")]
    out = [F.when(F.lower(plain) != F.lower(name), F.struct(plain.alias("name"), F.lit("remove-short-parenthetical-abbreviation").alias("transformation")))]
    out.append(F.when(F.contains(name, F.lit("|")) & (before != "") & (F.lower(before) != F.lower(name)), F.struct(before.alias("name"), F.lit("remove-local-name-after-pipe").alias("transformation"))))
    for end, joint in ends:
        rest = cut(end)
        bare = squeeze(F.regexp_replace(rest, joint, "")) if joint != "$" else squeeze(rest)
        fits = (place != "") & F.endswith(low, end) & (rest.rlike(joint) if joint != "$" else F.lit(True)) & (bare != "")
        out.append(F.when(fits, F.struct(bare.alias("name"), F.lit("remove-ranking-country-suffix").alias("transformation"))))
    return F.array_compact(F.array(*out))


def fold_search(c: Column) -> Column:
    """The folded form that search boxes compare; c is without marks already."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def tokens(c: Column) -> Column:
    """Sorted distinct tokens of two or more characters that are no stop words."""
    words = F.filter(F.split(fold_search(c), " "), lambda t: (F.length(t) > 1) & ~t.isin(*rules.NAME_STOP_WORDS))
    return F.array_sort(F.array_distinct(words))


def name_variants(c: Column) -> Column:
    """The token key of a name, and that of the name without a short acronym in parentheses at its end."""
    short = token_key(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\([A-Z0-9.&-]{2,10}\)\s*$", ""))
    return F.filter(F.array_distinct(F.array(token_key(F.coalesce(c, F.lit(""))), short)), lambda v: v != "")


def mapped(c: Column, values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[c]


def country(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """The label that a country is published under, or what one of the other alias tables says."""
    s = squeeze(F.coalesce(c, F.lit("")))
    return F.coalesce(mapped(s, aliases or rules.COUNTRY_ALIASES), s)


def registry_country(c: Column) -> Column:
    """A country as registries name it: lower case without marks (c is without them already), codes of two letters spelt out."""
    s = squeeze(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("_"), F.lit(" ")))
    return F.coalesce(F.when(F.length(s) == 2, mapped(s, rules.COUNTRY_CODES)), mapped(s, rules.REGISTRY_COUNTRIES), s)


def region(c: Column) -> Column:
    return F.coalesce(mapped(c, rules.REGIONS), c)


def material(c: Column, verified: Column) -> Column:
    """The published name of a material; null for ones that say little unless verified."""
    s = squeeze(c)
    low = F.lower(s)
    return F.when(~verified & low.isin(*rules.LOW_SIGNAL_MATERIALS), None).otherwise(F.coalesce(mapped(low, rules.MATERIAL_ALIASES), F.nullif(s, F.lit(""))))


def clean_title(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), "[­​‌‍]", ""))


def programme_title(c: Column) -> Column:
    found = F.regexp_extract(squeeze(c), r"(?i)^admission to the master'?s programme in\s+(.+)$", 1)
    return F.coalesce(F.nullif(found, F.lit("")), squeeze(c))


def safe_id(c: Column) -> Column:
    """An id that is safe as a file name; c is without marks already."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def plain_text(c: Column) -> Column:
    """Tags dropped; html_unescape() reads the entities."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", ""))


def first_int(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c.cast("string"), r"(\d+)", 1), F.lit("")).try_cast("int")


def visible_text(html_column: Column) -> Column:
    """Text of the body without scripts, styles and tags (entities as they are)."""
    body = F.regexp_extract(html_column, r"(?is)<body\b[^>]*>(.*?)</body\s*>", 1)
    body = F.when(body == "", html_column).otherwise(body)
    for tag in ("script", "style", "noscript", "svg", "template"):
        body = F.regexp_replace(body, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    return squeeze(F.regexp_replace(body, "<[^>]+>", " "))


def merge_unique(left: Column, right: Column) -> Column:
    """left and then what right adds to it, compared trimmed and in any case; empty values of right are left out."""
    key = lambda v: F.lower(F.trim(v))
    start = F.coalesce(left, F.array().cast("array<string>"))
    return F.aggregate(F.coalesce(right, F.array().cast("array<string>")), start, lambda acc, v: F.when((key(v) != "") & ~F.exists(acc, lambda a: key(a) == key(v)), F.array_append(acc, v)).otherwise(acc))


def split_list(c: Column) -> Column:
    """Trimmed parts between semicolons, empty ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda v: F.trim(v)), lambda v: v != "")


def parse_tests(c: Column) -> Column:
    """array<struct<name,score>> of `NAME:SCORE; NAME:SCORE`; parts without a colon are left out."""
    parts = F.filter(split_list(c), lambda v: F.contains(v, F.lit(":")))
    return F.transform(parts, lambda v: F.struct(F.upper(F.trim(F.substring_index(v, ":", 1))).alias("name"), F.trim(F.substring_index(v, ":", -1)).alias("score")))
