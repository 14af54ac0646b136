"""URL filters: pattern rules indexed by their rarest literal token. Native columns only.

From each pattern the tokens `[a-z0-9]+` that any matching url must hold are worked out (required_tokens): one set
for each way through its alternatives. The index files each way under the one of its tokens that is rarest in the
urls at hand (counted over all rows, for the rules' own tokens only, so the counts are bounded by the rule set). A
url's tokens that are in the index fetch candidate rules, and only those run their regular expression; a pattern
with a way that requires no token can't be filed and is refused.

Defined results: a null url or one without `://` has an empty host and path, fits no host rule, and pattern rules see
an empty string for null; repeated rows are judged each; a null page_id is kept; extra columns are ignored. Of host
rules that fit, the longest wins (the first of equally long ones). Where none fits, an allow pattern that matches is
an exception to the block patterns; if no pattern matches, the verdict is allow.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import table


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    verdict: str
    pattern: str  # searched in the url with A-Z lower-cased


HOST_RULES = (HostRule("block", "net", "/"), HostRule("allow", "example.net", "/en/"), HostRule("block", "example.com", "/de/"), HostRule("allow", "org", "/fr/"))

_HOST = r"://([^/?#]*[.-])?{}([.-][^/?#]*)?([/?#:]|$)"
PATTERN_RULES = (
    # Hosts of spam, by a label or a part of one between hyphens.
    *(PatternRule("block", _HOST.format(words)) for words in (
        "(casino|casinos|poker|jackpot|roulette|slots)", "(bet|bets|betting|bookmaker|gambling)", "(pills|pharmacy|viagra|cialis|meds)",
        "(adult|porn|xxx|sex|escort|escorts)", "(ads|ad|adserver|adservice|banner|banners)", "(track|tracker|trackers|tracking|pixel|clicks)",
        "(spam|seo|linkfarm|backlinks)", "(payday|loans|forex|replica|rolex)", "(warez|torrent|torrents|keygen|crack|cracks)", "(malware|phishing)",
    )),
    # Pages without text of their own.
    PatternRule("block", r"/(login|signin|signup|logout|register)(\.(php|html|aspx))?([/?#]|$)"),
    PatternRule("block", r"/(cart|checkout|basket|wishlist)([/?#]|$)"),
    PatternRule("block", r"/wp-(admin|login|json)([/.?#]|$)"),
    PatternRule("block", r"/cgi-bin/"),
    PatternRule("block", r"[?&](sessionid|phpsessid|jsessionid|sid)=[0-9a-f]{8,}"),
    PatternRule("block", r"[?&](replytocom|share|print)=[^&#]+"),
    PatternRule("block", r"/(calendar|events)/[0-9]{4}[/-][0-9]{2}([/?#]|$)"),
    PatternRule("block", r"/(feed|rss|atom)(\.xml)?/?([?#]|$)"),
    # Files that are no pages.
    PatternRule("block", r"\.(zip|rar|gz|tar|7z|exe|apk|dmg|iso|msi)([?#]|$)"),
    PatternRule("block", r"\.(jpg|jpeg|png|gif|svg|webp|ico|css|js|woff|woff2)([?#]|$)"),
    PatternRule("block", r"\.(mp3|mp4|avi|mov|mkv|wav)([?#]|$)"),
    # Exceptions: institutions that carry such words by right.
    PatternRule("allow", r"://([^/?#]*\.)?(edu|gov)(\.[a-z]{2})?([/?#:]|$)"),
    PatternRule("allow", r"://([^/?#]*\.)?ac\.[a-z]{2}([/?#:]|$)"),
    PatternRule("allow", r"://(developer|docs)\.[^/?#]+/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_EDGE, _OPEN = " ", None  # an item that ends a token for sure; one of which nothing is known
_MOST_WAYS = 256


def _ways(parsed) -> list[list]:
    """The ways through a parsed pattern, as lists of token characters, _EDGE and _OPEN."""
    out: list[list] = [[]]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            some = [[chr(arg) if chr(arg) in _WORD else _EDGE]]
        elif name in ("NOT_LITERAL", "ANY", "GROUPREF"):
            some = [[_OPEN]]
        elif name == "AT":
            some = [[_EDGE]]
        elif name == "IN":
            kinds = [(str(k), v) for k, v in arg]
            plain = all(k == "LITERAL" and chr(v) not in _WORD for k, v in kinds)
            no_word = kinds[0][0] == "NEGATE" and _WORD <= {chr(c) for k, v in kinds if k in ("LITERAL", "RANGE") for c in ([v] if k == "LITERAL" else range(v[0], v[1] + 1))}
            some = [[_EDGE]] if plain or no_word else [[_OPEN]]
        elif name == "SUBPATTERN":
            some = _ways(arg[3])
        elif name == "BRANCH":
            some = [w for b in arg[1] for w in _ways(b)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            once = _ways(inner)
            if (low, high) == (0, 1):
                some = [[], *once]
            elif (low, high) == (1, 1):
                some = once
            elif low == high <= 8 and len(once) == 1:
                some = [once[0] * low]
            else:
                edges = all(set(w) == {_EDGE} for w in once)
                some = ([[]] if low == 0 else []) + [[_EDGE if edges else _OPEN]]
        else:
            raise ValueError(f"{name} in a url pattern")
        out = [a + b for a, b in product(out, some)]
        if len(out) > _MOST_WAYS:
            raise ValueError("a url pattern of too many alternatives")
    return out


def required_tokens(pattern: str) -> list[set[str]]:
    """For each way through the pattern the whole tokens that a matching url holds."""
    out: list[set[str]] = []
    for way in _ways(re._parser.parse(pattern)):
        marked = "".join("\0" if c is _OPEN else c for c in way)
        found = {m[1] for m in re.finditer(rf"(?<={_EDGE})([a-z0-9]+)(?={_EDGE})", marked)}
        if found not in out:
            out.append(found)
    return out


def _low(column: str = "url") -> Column:
    return F.translate(F.coalesce(column, F.lit("")), _UPPER, _LOWER)


def _tokens(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), F.lit(1))


def literal_counts(pages: DataFrame, patterns: tuple[PatternRule, ...]) -> dict[str, int]:
    """In how many urls each token that a rule requires occurs; one row comes back."""
    literals = sorted({t for r in patterns for way in required_tokens(r.pattern) for t in way})
    if not literals:
        return {}
    mine = F.array(*map(F.lit, literals))
    row = pages.select(F.array_intersect(_tokens(_low()), mine).alias("t")).agg(*(F.count_if(F.array_contains("t", t)).alias(f"n{i}") for i, t in enumerate(literals))).first()
    return dict(zip(literals, row, strict=True))


def index(patterns: tuple[PatternRule, ...], counts: dict[str, int]) -> dict[str, list[PatternRule]]:
    """The rules filed under each literal: for every way through a pattern the rarest token that it requires."""
    out: dict[str, list[PatternRule]] = {}
    for r in patterns:
        ways = required_tokens(r.pattern)
        if not all(ways):
            raise ValueError(f"no token is sure to be in all urls that match {r.pattern}")
        for way in ways:
            at = out.setdefault(min(way, key=lambda t: (counts.get(t, 0), t)), [])
            if r not in at:
                at.append(r)
    return out


def host(url: str = "url") -> Column:
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: str = "url") -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, hosts: tuple[HostRule, ...] = HOST_RULES, patterns: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    filed = index(patterns, literal_counts(pages, patterns))
    rows = pages.select("page_id", F.coalesce(host(), F.lit("")).alias("host"), F.coalesce(path(), F.lit("")).alias("path"), _low().alias("low"))
    rows = rows.withColumn("hits", F.array_intersect(_tokens(F.col("low")), F.array(*map(F.lit, sorted(filed))) if filed else F.array().cast("array<string>")))

    def found(verdict: str) -> Column:
        tests = [F.when(F.array_contains("hits", t), reduce(lambda a, b: a | b, (F.col("low").rlike(r.pattern) for r in mine))).otherwise(False) for t, all_ in filed.items() if (mine := [r for r in all_ if r.verdict == verdict])]
        return reduce(lambda a, b: a | b, tests, F.lit(False))

    rule = said = None
    for r in sorted(hosts, key=lambda r: -len(r.name)):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        rule = F.when(fits, r.name) if rule is None else rule.when(fits, r.name)
        said = F.when(fits, r.verdict) if said is None else said.when(fits, r.verdict)
    method = F.when((F.size("hits") == 0) | ~found("block") | found("allow"), "allow").otherwise("block")
    return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule") if rule is None else rule.alias("rule"), method.alias("verdict") if said is None else F.coalesce(said, method).alias("verdict"))


def op10(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages", "page_id", "url"))


def _sql() -> str:
    lower = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = " UNION ALL ".join(f"SELECT '{r.verdict}' AS v, '{r.host}' AS h, '{r.path}' AS p" for r in HOST_RULES)
    any_of = lambda v: " OR ".join(f"regexp_matches(low, '{r.pattern}')" for r in PATTERN_RULES if r.verdict == v)
    return rf"""
WITH u AS (SELECT page_id, row_number() OVER () AS n, {lower} AS low, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS cut FROM pages),
s AS (SELECT page_id, n, low, CASE WHEN cut > 0 THEN substr(url, cut + 3) ELSE '' END AS rest FROM u),
w AS (SELECT page_id, n, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM s),
rules AS ({rules}),
hit AS (SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict FROM w JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN ({any_of("block")}) AND NOT ({any_of("allow")}) THEN 'block' ELSE 'allow' END) AS verdict FROM w LEFT JOIN hit USING (n)
"""


ORACLE = _sql()
