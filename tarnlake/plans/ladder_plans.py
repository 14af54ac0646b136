"""Ordered rules over titles, urls, links and institutions, with the cases dealt out over whole test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.functions import page_rules as P
from tarnlake.functions import rules, text, urls
from tarnlake.operators import dedup, ladders
from tarnlake.plans.registry import has_sql as has
from tarnlake.plans.registry import ladder_sql, pick, pick_sql, quoted, registry
from tarnlake.sources.readers import parquet

QUERIES: dict = {}
ORACLES: dict = {}
query = registry(QUERIES, ORACLES)

TITLES = (
    "MSc Data Science", "Master's programmes", "Admission requirements", "Bachelor of Arts", "abc", "PhD in Physics", "Cookie settings", "Master of Civil Engineering", "Open day", "Graduate School",
    "Computer Science and Engineering (MSc)", "Postgraduate certificate in Law", "Scholarships", "Masters", "Software systems", "How to apply", "Doctoral school", "Find your Master - University", "Page not found",
)
URLS = (
    "https://www.example.edu/masters/data-science", "http://study.example.edu/graduate/programmes", "https://example.edu/news/2024", "ftp://example.edu/master", "https://other.org/master/engineering", "https://www.example.edu/",
    "https://mastersportal.com/programmes/1", "https://www.example.edu/undergraduate/courses", "https://pg.example.edu/postgraduate/computer-science?level=master", "https://example.edu/programs/graduate-certificate", "https://example.edu/&utm_source=x",
    "https://lab.example.edu/degree-programs.html", "https://example.edu/graduate/call-for-papers", "https://example.edu/master/tuition-fees/", "https://example.edu/phd", "https://example.edu/study/about", "not a url", "https://example.edu/master-thesis/electrical-engineering",
    "https://example.edu/graduate-program", "https://x.example.edu/research/masters/robotics",
)
DOMAINS = ("example.edu", "other.org")
_HOST = r"regexp_replace(regexp_replace(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^[^@]*@|:[0-9]*$', ''), '^www\.', '')"
_SPLIT = f"""{_HOST.format(u="u")} AS host, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '^[^?#]*\\?([^#]*)', 1) AS query, regexp_matches(u, '^https?://[^/?#]+') AS web"""
_DENIED = "len(list_filter([" + ", ".join(map(quoted, rules.DENIED_HOSTS)) + "], lambda d: host = d OR ends_with(host, '.' || d))) > 0"
_CASES = f"c AS (SELECT p_partkey, {pick_sql(TITLES, 'p_partkey')} AS t, {pick_sql(URLS, 'p_partkey', 3)} AS u FROM part), s AS (SELECT *, {_SPLIT} FROM c)"
_REASONS = [("empty-title", "length(t) < 4"), ("category-or-information-page", f"({has('t', P.JUNK_TITLE)} OR {has('t', P.INFO_PAGE_TITLE)})"), ("non-master-degree", has("t", P.NON_MASTER_TITLE))]
_PATH_REASONS = [("invalid-source-url", "NOT web"), ("non-program-path", f"({has('slashed', P.BLOCKED_PATH)} OR {has('slashed', P.BLOCKED_PATH_FRAGMENT)})")]


def _cases(spark, d):
    return parquet(spark, d, "part").select("p_partkey", pick(TITLES, "p_partkey").alias("t"), pick(URLS, "p_partkey", 3).alias("u"))


@query(f"""WITH {_CASES}, r AS (SELECT *, regexp_replace(path, '/+$', '') || '/' AS slashed FROM s), q AS (SELECT p_partkey, t, {ladder_sql(_REASONS + _PATH_REASONS + [("third-party-source", _DENIED)], "")} AS reason, {ladder_sql([*_REASONS, ("third-party-source", _DENIED)], "")} AS strict FROM r)
SELECT p_partkey, reason, strict, ({has("t", P.LIST_NOISE)} OR {has("t", P.LIST_NOISE_ANY)} OR (p_partkey % 5 = 0 AND p_partkey % 3 = 0 AND p_partkey % 4 < 2)) AS noise, ({has("t", P.STORE_JUNK_TITLE)} OR strict <> '' OR (length(t) <= 8 AND p_partkey % 2 = 0 AND p_partkey % 4 = 0)) AS junk FROM q""")
def programme_reasons(spark, d):
    """Why a page is no programme, by title and url; titles that lists and the store leave out."""
    k, t, u = F.col("p_partkey"), F.col("t"), F.col("u")
    subject = F.when(k % 5 == 0, "General").otherwise("Physics")
    return _cases(spark, d).select(
        "p_partkey", ladders.non_programme_reason(t, u).alias("reason"), ladders.non_programme_reason(t, u, strict=True).alias("strict"),
        ladders.is_noise(t, subject, (k % 3).cast("int"), (k % 4).cast("int")).alias("noise"), ladders.is_junk(t, u, k % 2 == 1, (k % 4).cast("int")).alias("junk"),
    )


_KEYWORDS = [(w, "high") for w in P.HIGH_KEYWORDS] + [(w, "adjacent") for w in P.ADJACENT_KEYWORDS]


@query(f"""WITH {_CASES}, k AS (SELECT unnest([{", ".join(f"{{'w': {quoted(w)}, 'p': {quoted(p)}}}" for w, p in _KEYWORDS)}]) AS x),
f AS (SELECT p_partkey, unnest([{{'l': 'title', 'v': t}}, {{'l': 'url', 'v': u}}]) AS y FROM s), h AS (SELECT p_partkey, x.p AS p, x.w AS w, y.l AS l FROM f, k WHERE regexp_matches(y.v, '(?i)\\b' || x.w || '\\b'))
SELECT p_partkey, count(*) AS hits, bool_or(p = 'high') AS candidate, count(DISTINCT w) AS words FROM h GROUP BY p_partkey""")
def keyword_candidates(spark, d):
    """Engineering keywords by priority and place; pages with any are in the result, those with a high one are candidates."""
    rows = _cases(spark, d).select("p_partkey", ladders.keyword_hits({"title": F.col("t"), "url": F.col("u")}).alias("h")).where("size(h) > 0")
    return rows.select("p_partkey", F.size("h").cast("long").alias("hits"), ladders.is_candidate(F.col("h")).alias("candidate"), F.size(F.array_distinct(F.transform("h", lambda x: x["keyword"]))).cast("long").alias("words"))


def _terms(p):
    return f"list_sort(list_distinct(regexp_extract_all(lower(x), {quoted(p)})))"


@query(f"""WITH {_CASES}, x AS (SELECT p_partkey, t || ' ' || u AS x FROM s), l AS (SELECT p_partkey, {_terms(P.CS_TERMS)} AS cs, {_terms(P.ENGINEERING_TERMS)} AS en FROM x)
SELECT p_partkey, CASE WHEN len(cs) > 0 AND len(en) > 0 THEN 'strong' WHEN len(cs) + len(en) > 0 THEN 'moderate' ELSE 'unknown' END AS level, array_to_string(cs, ',') AS cs, array_to_string(en, ',') AS engineering FROM l""")
def discipline_scope(spark, d):
    found = _cases(spark, d).select("p_partkey", ladders.discipline_signals(F.concat_ws(" ", "t", "u")).alias("x"))
    return found.select("p_partkey", "x.level", F.array_join("x.cs", ",").alias("cs"), F.array_join("x.engineering", ",").alias("engineering"))


_KINDS = ("master-catalog", "application-deadline", "required-documents", "program-page")
_TRUST = "len(list_filter([" + ", ".join(map(quoted, DOMAINS)) + "], lambda d: {h} = d OR ends_with({h}, '.' || d))) > 0"
_GRAD, _CAT = has("said", P.URL_GRADUATE_LEVEL), has("said", P.URL_CATALOG_SIGNAL)
_CRAWL = [
    ("invalid-url", "NOT web"), ("aggregator", has("u", P.URL_AGGREGATOR)), ("no-trusted-domain", "p_partkey % 11 = 0"), ("off-trusted-domain", f"NOT {_TRUST.format(h='host')}"), ("not-specific", f"NOT {has('said', P.URL_SPECIFIC)}"),
    ("wrong-level", f"({has('said', P.URL_WRONG_LEVEL)} OR {has('said', P.URL_DOCTORAL_LEVEL)})"), ("non-master-qualification", has("said", P.URL_NON_MASTER_QUALIFICATION)), ("generic-or-noise", has("said", P.URL_NON_PROGRAM_DETAIL)),
    ("not-graduate-level", f"NOT {_GRAD}"), ("generic-or-noise", f"({has('said', P.URL_NOISE)} AND NOT ({_GRAD} AND {_CAT}))"), ("announcement", f"({has('said', '(?:call[-_ ]?for|announcement)')} AND NOT {_CAT})"),
    ("root-url", f"(trim(path, '/') = '' AND NOT {has('host', P.URL_SPECIFIC)})"), ("generic-admissions", f"(kind IN ('application-deadline', 'required-documents') AND NOT ({_GRAD} OR {_CAT}))"),
]
_MASTER = r"\bmaster(?:s)?\b"
_APPLICATION = [
    ("application-not-captured", "p_partkey % 6 = 0"), ("application-out-of-scope", "p_partkey % 7 = 0"), ("application-canonical-id-mismatch", "p_partkey % 13 = 0"), *_CRAWL, ("application-non-program", has("said", P.APPLICATION_NOISE)),
    ("accepted-application-catalog", f"({has('path', P.APPLICATION_CATALOG_ENDPOINT)} OR ({has('path', P.URL_CATALOG_SIGNAL)} AND {has('query', _MASTER)}) OR {has('path', P.URL_POSTGRADUATE_GUIDE)})"),
    ("accepted-application-scope-program", f"({has('said', _MASTER)} AND {has('said', P.URL_CS_ENGINEERING_URL)})"),
]
_MERGED = "CASE WHEN regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) IN ('', '/') THEN u ELSE regexp_replace(u, '/+$', '') END"


@query(f"""WITH c AS (SELECT p_partkey, {pick_sql(URLS, "p_partkey")} AS u, {pick_sql(_KINDS, "p_partkey", 2)} AS kind FROM part), m AS (SELECT p_partkey, kind, {_MERGED} AS u FROM c), s AS (SELECT *, {_SPLIT} FROM m), r AS (SELECT *, host || ' ' || path || ' ' || query AS said FROM s)
SELECT p_partkey, {ladder_sql(_CRAWL, "accepted")} AS reason, {ladder_sql(_APPLICATION, "application-not-catalog-or-scope-program")} AS application_reason FROM r""")
def official_url_gates(spark, d):
    """Reasons of crawled urls and of urls that an application audit found, by trusted domains."""
    k = F.col("p_partkey")
    rows = parquet(spark, d, "part").select("p_partkey", urls.merge_url(pick(URLS, "p_partkey")).alias("u"), pick(_KINDS, "p_partkey", 2).alias("kind"))
    trusted = F.when(k % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, DOMAINS)))
    u = F.col("u")
    status = F.when(k % 6 != 0, "captured").otherwise("error")
    return rows.select("p_partkey", ladders.crawl_url_reason(u, trusted, F.col("kind")).alias("reason"), ladders.application_url_reason(u, trusted, status, k % 7 != 0, k % 13 != 0).alias("application_reason"))


_SOME, _LEVEL = "(?:programmes?|programs?|degrees?|courses?)", "(?:graduate|postgraduate|master)"
_LISTED = r"^(?:(?:degree[-_])?(?:programmes?|programs?|degrees?|courses?|overview)(?:\.(?:html?|aspx?))?)$"
_SEGMENT = "^(?:programmes?|programs?|degrees?|courses?|(?:programmes?|programs?)[-_]of[-_]study)$"
# RE2 has no look-ahead: the part with one is two patterns in SQL.
_NON_SCOPE = P.CAPTURED_NON_SCOPE_CATALOG.replace(r"(?!\s+and\s+sciences?)", "")
_ARTS_AND_SCIENCES = r"\b(?:school|faculty|department) of arts?\b\s+and\s+sciences?"
_CAPTURED = [
    ("captured-not-captured", "p_partkey % 17 = 0"), ("captured-blocked-or-dynamic", "p_partkey % 19 = 0"), ("captured-discovery-only", "p_partkey % 23 = 0"), ("captured-wrong-kind", "kind = 'evidence'"), ("captured-http-status", "p_partkey % 29 = 0"),
    ("invalid-url", "NOT web"), ("no-ror-domain", "p_partkey % 31 = 0"), ("off-ror-domain", "NOT host_ok"), ("aggregator", has("u", P.URL_AGGREGATOR)), ("captured-not-found-page", has("t", r"page not found|\b404\b")), ("captured-thin-page", "p_partkey % 37 = 0"),
    ("wrong-level", f"({has('u', P.URL_DOCTORAL_LEVEL)} OR {has('u', P.URL_NON_MASTER_QUALIFICATION)})"), ("generic-or-noise", f"({has('u', P.URL_NON_PROGRAM_DETAIL)} OR {has('u', P.URL_NOISE)} OR {has('u', P.CAPTURED_URL_NOISE)})"),
    ("wrong-level", has("t", P.CAPTURED_BACHELOR_LEVEL)), ("wrong-level", f"({has('surface', P.URL_WRONG_LEVEL)} AND NOT (catalog AND NOT {has('t', P.URL_WRONG_LEVEL)}))"), ("non-master-qualification", f"({has('surface', P.URL_NON_MASTER_QUALIFICATION)} AND NOT master_catalog)"),
    ("root-url", "at_root AND NOT catalog"), ("captured-non-scope-catalog", f"catalog AND {has('surface', _NON_SCOPE)} AND NOT {has('surface', _ARTS_AND_SCIENCES)} AND NOT scope"), ("captured-noncentral-catalog", "catalog AND NOT central AND NOT scope"),
    ("accepted-captured-catalog", f"catalog AND {has('surface', P.CAPTURED_MASTER_LEVEL)}"), ("captured-non-program-page", "title_noise OR last_noise"), ("wrong-level", has("t", P.URL_DOCTORAL_LEVEL)),
    ("accepted-captured-scope-program", f"{has('surface', P.CAPTURED_MASTER_LEVEL)} AND scope AND NOT ({has('surface', P.CAPTURED_NON_ENGINEERING_SCIENCE)} AND NOT {has('surface', chr(92) + 'bengineering' + chr(92) + 'b')})"),
]
_PAGE_KINDS = ("program", "category", "evidence", "Catalog")


@query(rf"""WITH c AS (SELECT p_partkey, {pick_sql(TITLES, "p_partkey")} AS t, {pick_sql(URLS, "p_partkey", 3)} AS u, {pick_sql(_PAGE_KINDS, "p_partkey", 5)} AS kind, p_name AS body, (p_partkey % 3)::INT AS links FROM part), s AS (SELECT *, {_SPLIT} FROM c),
a AS (SELECT *, u || ' ' || t || ' ' || body AS surface, list_filter(string_split(regexp_replace(path, '/+$', ''), '/'), lambda v: v <> '') AS seg, regexp_split_to_array(t, '\s+(?:\||::|[-–—])\s+')[1] AS first_part, {_TRUST.format(h="host")} AS host_ok FROM s),
b AS (SELECT *, len(seg) = 0 AS at_root, coalesce(seg[-1], '') AS last, coalesce(seg[-2], '') AS before, {has("first_part", P.CAPTURED_CATALOG_TITLE)} AS title_catalog, {has("t", P.CAPTURED_PAGE_NOISE)} AS title_noise, {has("surface", P.URL_CS_ENGINEERING_URL)} AS scope,
host IN ('example.edu', 'other.org') OR len(list_filter(string_split(regexp_replace(host, '\.(example\.edu|other\.org)$', ''), '.'), lambda l: {has("l", "^(?:" + P.CAPTURED_CENTRAL_SUBDOMAIN + ")$")})) > 0 AS central FROM a),
e AS (SELECT *, {has("replace(last, '-', ' ')", P.CAPTURED_PAGE_NOISE)} AS last_noise, ({has("last", P.CAPTURED_CATALOG_ENDPOINT)} OR (len(seg) >= 2 AND {has("before", "master|graduate|postgraduate")} AND {has("last", _LISTED)})) AS endpoint,
({has("last", _SEGMENT)} AND {has("t", rf"{chr(92)}b{_SOME}{chr(92)}b.{{0,80}}{chr(92)}b{_LEVEL}{chr(92)}b|{chr(92)}b{_LEVEL}{chr(92)}b.{{0,80}}{chr(92)}b{_SOME}{chr(92)}b")}) AS combined, at_root AND title_catalog AS dedicated FROM b),
f AS (SELECT *, ((((title_catalog OR combined) AND NOT {has("first_part", P.CAPTURED_ORGANIZATION_NOISE)}) AND (endpoint OR dedicated OR lower(kind) IN ('category', 'catalog') OR links > 0)) OR ((endpoint OR dedicated) AND NOT {has("t", P.CAPTURED_ORGANIZATION_NOISE)} AND links > 0)) AND NOT title_noise AND NOT last_noise AS catalog FROM e),
g AS (SELECT *, catalog AND {has("first_part", chr(92) + "b(?:master(?:'?s)?|postgraduate)" + chr(92) + "b")} AND {has("first_part", chr(92) + "b(?:programmes?|programs?|degrees?|courses?|catalog(?:ue)?)" + chr(92) + "b")} AS master_catalog FROM f),
r AS (SELECT p_partkey, scope, {ladder_sql(_CAPTURED, "captured-not-catalog-or-scope-program")} AS reason FROM g)
SELECT p_partkey, reason, CASE reason WHEN 'accepted-captured-catalog' THEN CASE WHEN scope THEN 320 ELSE 300 END WHEN 'accepted-captured-scope-program' THEN 220 ELSE 0 END::INT AS score FROM r""")
def captured_page_gates(spark, d):
    """Reasons and scores of captured pages as official coverage."""
    k = F.col("p_partkey")
    rows = parquet(spark, d, "part").select("p_partkey", pick(TITLES, "p_partkey").alias("t"), pick(URLS, "p_partkey", 3).alias("u"), pick(_PAGE_KINDS, "p_partkey", 5).alias("kind"), "p_name")
    trusted = F.when(k % 31 == 0, F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, DOMAINS)))
    found = ladders.captured_page(
        F.col("u"), trusted, F.when(k % 17 != 0, "captured").otherwise("error"), F.col("kind"), F.when(k % 29 == 0, 500).otherwise(200), F.col("t"), F.col("p_name"), F.lit(None).cast("string"),
        k % 19 == 0, k % 23 != 0, F.when(k % 37 == 0, 20).otherwise(4000), (k % 3).cast("int"),
    )
    return rows.select("p_partkey", found.alias("x")).select("p_partkey", "x.reason", "x.score")


_WORDS = ("Robotics lab", "Entry rules", "Dates and windows", "Your cv", "English test", "Welcome", "Domain name")


@query("WITH x AS (SELECT p_partkey, lower(" + pick_sql(_WORDS, "p_partkey") + " || ' ' || p_name) AS l FROM part), k AS (SELECT p_partkey, " + ladder_sql([(n, "(" + " OR ".join(f"contains(l, {quoted(w)})" for w in words) + ")") for n, words in ladders.LINK_KINDS], "master-catalog") + " AS kind FROM x) SELECT kind, kind <> 'home' AND kind IN (" + ", ".join(map(quoted, ladders.COVERAGE_KINDS)) + ") AS counts, count(*) AS n FROM k GROUP BY ALL")
def url_kinds(spark, d):
    rows = parquet(spark, d, "part").select(ladders.link_kind(F.concat_ws(" ", pick(_WORDS, "p_partkey"), "p_name")).alias("kind"))
    return rows.groupBy("kind", ladders.counts_as_coverage(F.col("kind")).alias("counts")).agg(F.count("*").alias("n"))


_FINDINGS = [("generic-domain-root", "(p = '/' AND query = '')"), ("non-master-degree-level", has("bare || p", P.NON_MASTER_DEGREE_PATH)), *((n, has("p", q)) for n, q in P.NON_PROGRAM_KINDS)]


@query(rf"""WITH c AS (SELECT p_partkey, p_size % 5 AS owner, {pick_sql(URLS, "p_partkey")} AS u FROM part), s AS (SELECT *, {_SPLIT} FROM c), b AS (SELECT *, CASE WHEN path = '' THEN '/' ELSE path END AS p, lower(regexp_extract(u, '://([^/?#]*)', 1)) AS bare FROM s),
f AS (SELECT u, owner, {ladder_sql(_FINDINGS, None)} AS finding, {has("path", P.MALFORMED_TRACKING_PATH)} AS tracked FROM b), o AS (SELECT u, list_sort(list(DISTINCT 'u_' || owner)) AS owners, min(finding) AS finding, bool_or(tracked) AS tracked, count(*) AS n FROM f GROUP BY u)
SELECT u, n, finding, tracked, CASE WHEN owners = ['u_0', 'u_1', 'u_2', 'u_3', 'u_4'] THEN CASE WHEN finding IS NULL THEN 'same-institution-alias' ELSE 'same-institution-alias-non-program-url' END ELSE 'unclassified-cross-canonical' END AS shared, round_even(n / (SELECT count(*) FROM part), 4) AS share FROM o""")
def url_quality_review(spark, d):
    """Findings on urls, tracking in their paths, what it means that several institutions share one, and ratios."""
    rows = parquet(spark, d, "part").select(F.concat(F.lit("u_"), F.col("p_size") % 5).alias("owner"), pick(URLS, "p_partkey").alias("u"))
    found = rows.groupBy("u").agg(F.array_sort(F.collect_set("owner")).alias("owners"), F.count("*").alias("n"))
    total = F.lit(rows.count())
    f = ladders.url_finding(F.col("u"))
    known = [frozenset(f"u_{i}" for i in range(5))]
    return found.select("u", "n", f.alias("finding"), ladders.tracking_finding(F.col("u")).isNotNull().alias("tracked"), ladders.shared_url_kind(F.col("owners"), known, f).alias("shared"), F.bround(F.col("n") / total, 4).alias("share"))


_EXCLUDED = [("not-verified", "p_partkey % 3 = 0"), ("not-no-candidates", "p_partkey % 5 = 0"), ("official-domains-incomplete", "p_partkey % 7 = 0"), ("recorded-homepage-missing", "u = ''"), ("recorded-homepage-invalid", "NOT web"), ("recorded-homepage-not-official", f"NOT {_TRUST.format(h='host')}")]
_HOMES = ("", "https://www.example.edu/", "http://else.net/", "example.edu", "https://b.other.org/x")


@query(f"WITH c AS (SELECT p_partkey, {pick_sql(_HOMES, 'p_partkey', 2)} AS u FROM part), s AS (SELECT *, {_SPLIT} FROM c), r AS (SELECT {ladder_sql(_EXCLUDED, None)} AS reason FROM s) SELECT reason, count(*) AS n FROM r GROUP BY reason")
def browser_queue_exclusions(spark, d):
    k = F.col("p_partkey")
    rows = parquet(spark, d, "part").select("p_partkey", pick(_HOMES, "p_partkey", 2).alias("u"))
    domains = F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, DOMAINS)))
    reason = ladders.queue_exclusion(F.when(k % 3 != 0, "verified").otherwise("review"), F.when(k % 5 != 0, "no-candidates").otherwise("done"), domains, F.col("u"))
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


_STATES = ("pending", "captured", "error", "redirected", "blocked", "error", "failed")
_CODES = (None, 200, 301, 404, 403, 429, 500, 418, 410)
_ERRORS = ("", "too many redirects", "captcha", "timeout")
_OUTCOMES = [
    ("pending", "s IN ('pending', 'loading', 'queued', 'not-started')"), ("captured", "s IN ('captured', 'complete', 'success')"), ("redirectError", f"(contains(s, 'redirect') OR coalesce(code BETWEEN 300 AND 399, false) OR {has('e', 'too many redirects')})"),
    ("terminalError", "coalesce(code IN (404, 405, 410), false)"), ("blocked", f"(s = 'blocked' OR event_id % 11 = 0 OR coalesce(code IN (401, 403, 406, 451), false) OR {has('e', 'captcha')})"),
]


@query(f"""WITH c AS (SELECT event_id, user_id, {pick_sql(_STATES, "event_id")} AS s, {pick_sql(_CODES, "event_id", 7)} AS code, {pick_sql(_ERRORS, "event_id", 3)} AS e FROM events), r AS (SELECT *, {ladder_sql(_OUTCOMES, "retryableError")} AS outcome FROM c)
SELECT outcome, count(*) AS pages, sum(1 + user_id % 3)::BIGINT AS entries, count(*) FILTER (e <> '' AND event_id % 11 <> 0 AND (code IS NULL OR code IN (408, 425, 429) OR code BETWEEN 500 AND 599)) AS again FROM r GROUP BY outcome""")
def page_outcomes(spark, d):
    """What records of pages come to, weighted by ranking entries, and how many are worth another try."""
    from tarnlake.streaming.state import retryable

    k = F.col("event_id")
    rows = parquet(spark, d, "events").select("event_id", "user_id", pick(_STATES, "event_id").alias("s"), pick(_CODES, "event_id", 7).cast("int").alias("code"), pick(_ERRORS, "event_id", 3).alias("e"))
    outcome = ladders.page_outcome(F.col("s"), F.col("code"), F.col("e"), k % 11 == 0)
    again = retryable(F.nullif("e", F.lit("")), k % 11 == 0, F.col("code"))
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("pages"), F.sum(1 + F.col("user_id") % 3).alias("entries"), F.count_if(again).alias("again"))


@query(rf"""WITH v AS (SELECT page_id, trim(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '<[^>]+>|\s+', ' ', 'g')) AS t FROM pages), w AS (SELECT page_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM v),
r AS (SELECT *, {has("substr(t, 1, 3000)", P.LINK_BLOCKED_TEXT)} OR page_id % 13 = 0 AS blocked FROM w) SELECT page_id, CASE WHEN blocked THEN 'blocked' WHEN page_id % 5 <> 0 THEN 'captured' ELSE 'error' END AS status, blocked, page_id % 5 <> 0 AND length(t) < 400 AS dynamic_shell FROM r""")
def response_records(spark, d):
    k = F.col("page_id")
    stripped = F.regexp_replace(F.regexp_replace("html", r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>", " "), "<[^>]+>", " ")
    rows = parquet(spark, d, "pages").select("page_id", text.squeeze(stripped).alias("t"))
    found = ladders.response_status(k % 5 != 0, F.when(k % 13 == 0, 403).otherwise(200), F.lit("text/HTML; charset=utf-8"), F.col("t"))
    return rows.select("page_id", found.alias("x")).select("page_id", "x.*")


_OFFICIAL = ("verified", "blocked", "rejected", "review", "none")
_GOAL = [
    ("existing-program-raw", "coalesce(ex > 0, false)"), ("new-program-raw", "coalesce(nw > 0, false)"), ("verified-zero-candidates", "nw IS NOT NULL"), ("existing-zero-candidates", "ex IS NOT NULL"), ("verified-target-manifest-missing", "official = 'verified'"),
    ("official-blocked", "official = 'blocked'"), ("official-rejected", "official = 'rejected'"), ("official-review", "official = 'review'"), ("existing-target-manifest-missing", "c_custkey % 2 = 0"),
]
_CAPTURE = [("blocked", "category = 'official-blocked'"), ("needs-review", "category IN ('official-review', 'official-rejected', 'official-discovery-missing', 'existing-target-manifest-missing', 'verified-target-manifest-missing')"), ("captured", "c_custkey % 5 = 1"), ("checked-no-program", "ex IS NOT NULL OR nw IS NOT NULL OR coalesce(ex, 0) + coalesce(nw, 0) > 0")]


@query(f"""WITH c AS (SELECT c_custkey, c_nationkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 4 END AS ex, CASE WHEN c_custkey % 7 < 2 THEN c_custkey % 2 END AS nw, {pick_sql(_OFFICIAL, "c_custkey", 2)} AS official FROM customer), g AS (SELECT *, {ladder_sql(_GOAL, "official-discovery-missing")} AS category FROM c),
s AS (SELECT *, {ladder_sql(_CAPTURE, "pending")} AS status FROM g) SELECT c_nationkey, arg_max(status, CASE status WHEN 'captured' THEN 5 WHEN 'checked-no-program' THEN 4 WHEN 'needs-review' THEN 3 WHEN 'blocked' THEN 2 ELSE 1 END) AS status, count(DISTINCT category) AS categories, sum(coalesce(ex, 0) + coalesce(nw, 0))::BIGINT AS candidates, arg_min(c_name, (length(c_name), c_custkey)) AS name FROM s GROUP BY c_nationkey""")
def capture_report(spark, d):
    """Goal categories and capture statuses of institutions, merged by group: sums, the shortest name, the best status."""
    k = F.col("c_custkey")
    rows = parquet(spark, d, "customer").select("c_custkey", "c_nationkey", "c_name", F.when(k % 3 == 0, k % 4).alias("ex"), F.when(k % 7 < 2, k % 2).alias("nw"), pick(_OFFICIAL, "c_custkey", 2).alias("official"))
    rows = rows.withColumn("category", ladders.goal_category(F.col("ex"), F.col("nw"), F.col("official"), k % 2 == 0))
    manifests = F.col("ex").isNotNull().cast("int") + F.col("nw").isNotNull().cast("int")
    candidates = F.coalesce("ex", F.lit(0)) + F.coalesce("nw", F.lit(0))
    rows = rows.withColumn("candidates", candidates).withColumn("status", ladders.capture_status(F.col("category"), manifests, F.col("candidates"), F.when(k % 5 == 1, 1).otherwise(0)))
    place = text.mapped(F.col("status"), {k: str(v) for k, v in rules.CAPTURE_STATUSES.items()}).cast("int")
    return rows.groupBy("c_nationkey").agg(
        F.max_by("status", place).alias("status"), F.count_distinct("category").alias("categories"), F.sum("candidates").alias("candidates"), F.min_by("c_name", F.struct(F.length("c_name"), "c_custkey")).alias("name"),
    )


_BODIES = ("welcome", "Just a moment...", "about us")
_V = {n: f"(p_partkey % {m} <> 0)" for n, m in (("known", 17), ("country", 7), ("name", 11), ("domains", 13), ("url", 19), ("domain", 5), ("final", 3), ("identity", 2))}
_EARLY = "(NOT country OR NOT name OR (url AND domains AND NOT domain))"
_VERIFY = f"""WITH c AS (SELECT p_partkey, {", ".join(f"{e} AS {n}" for n, e in _V.items())}, {pick_sql((200, 404, 503, 302), "p_partkey", 4)} AS code, {pick_sql(_BODIES, "p_partkey", 6)} AS body, p_partkey % 4 = 1 AS redirected, p_partkey % 23 = 0 AS failed FROM part),
l AS (SELECT *, known AND NOT {_EARLY} AND url AS live, (code = 503 OR body = 'Just a moment...') AS wall FROM c), r AS (SELECT *, live AND NOT failed AS seen FROM l), h AS (SELECT *, seen AND NOT wall AND NOT code BETWEEN 200 AND 399 AS err, seen AND NOT wall AND code BETWEEN 200 AND 399 AS ok FROM r),
f AS (SELECT *, ok AND NOT final AS gone, ok AND final AND NOT identity AS mis, ok AND final AND identity AND domains AND domain AS good FROM h)"""


@query(_VERIFY + """ SELECT p_partkey, CASE WHEN (known AND """ + _EARLY + """) OR gone THEN 'rejected' WHEN (live AND failed) OR (seen AND wall) THEN 'blocked' WHEN good THEN 'verified' ELSE 'review' END AS status,
array_to_string(list_filter([CASE WHEN NOT known THEN 'ror_match_missing' END, CASE WHEN known AND NOT country THEN 'ror_country_mismatch' END, CASE WHEN known AND NOT name THEN 'ror_name_not_matched' END, CASE WHEN known AND NOT domains THEN 'ror_domains_missing' END, CASE WHEN known AND NOT url THEN 'website_url_missing' END,
CASE WHEN known AND url AND domains AND NOT domain THEN 'website_domain_not_in_ror_domains' END, CASE WHEN live AND failed THEN 'live_page_fetch_failed' END, CASE WHEN seen AND wall THEN 'waf_or_access_block' END, CASE WHEN err THEN 'live_page_http_error' END, CASE WHEN gone THEN 'redirected_domain_not_in_ror_domains' END, CASE WHEN mis THEN 'live_page_identity_mismatch' END, CASE WHEN good AND redirected THEN 'redirected_within_ror_domain' END], lambda x: x IS NOT NULL), ',') AS reasons FROM f""")
def verification_states(spark, d):
    """Institutions' websites against the registry, with all reasons."""
    return _verified(spark, d).select("p_partkey", "v.status", F.array_join("v.reasons", ",").alias("reasons"))


def _verified(spark, d):
    k = F.col("p_partkey")
    on = lambda m: k % m != 0
    found = ladders.verification(on(17), on(7), on(11), on(13), on(19), on(5), pick((200, 404, 503, 302), "p_partkey", 4), pick(_BODIES, "p_partkey", 6), on(3), on(2), k % 4 == 1, k % 23 == 0)
    return parquet(spark, d, "part").select("p_partkey", found.alias("v"))


@query(_VERIFY + """, t AS (SELECT p_partkey, CASE WHEN (known AND """ + _EARLY + """) OR gone THEN 'rejected' ELSE 'other' END AS status, NOT known AS missing, mis, known AND NOT name AS unnamed, gone, err, code FROM f),
a AS (SELECT *, CASE WHEN mis AND p_partkey % 5 = 1 THEN 'multilingual-title' WHEN mis AND p_partkey % 5 = 2 THEN 'acronym-or-brand-title' WHEN mis AND p_partkey % 5 = 3 THEN 'acronym-title' WHEN unnamed AND p_partkey % 2 = 0 THEN 'parenthetical-acronym-or-brand' WHEN gone AND code BETWEEN 200 AND 399 AND (p_partkey % 2 = 1 OR p_partkey % 9 = 0) THEN 'official-domain-redirect' END AS auto FROM t),
y AS (SELECT *, CASE WHEN p_partkey % 29 = 0 THEN 'relationship-rule-required' WHEN missing THEN 'ror-missing' WHEN auto IS NOT NULL THEN 'auto-recoverable' WHEN status = 'rejected' THEN 'true-rejection' ELSE 'blocked' END AS category FROM a)
SELECT category, CASE category WHEN 'relationship-rule-required' THEN 'configured-non-merging-relationship' WHEN 'ror-missing' THEN 'saved-ror-candidates-require-review' WHEN 'auto-recoverable' THEN auto WHEN 'true-rejection' THEN 'selected-ror-identity-conflicts-with-target' ELSE CASE WHEN err THEN 'http-error' ELSE 'static-page-identity-inconclusive' END END AS mode, count(*) AS n FROM y GROUP BY ALL""")
def identity_triage(spark, d):
    k = F.col("p_partkey")
    found = ladders.identity_triage(F.col("v.status"), F.col("v.reasons"), k % 29 == 0, k % 5 == 1, k % 5 == 2, k % 5 == 3, k % 2 == 0, k % 2 == 1, k % 9 == 0, pick((200, 404, 503, 302), "p_partkey", 4))
    return _verified(spark, d).select(found.alias("x")).groupBy("x.category", "x.mode").agg(F.count("*").alias("n"))


_LABELS = ("Master's programmes", "All programmes", "Graduate studies catalogue", "News and events", "Apply now", "Bachelor courses", "Next", "MSc Robotics programme", "Academic departments", "Deadlines and required documents", "English language requirements", "Privacy", "3")
_LINKS = ("https://example.edu/masters", "https://example.edu/programs/data-science", "https://example.edu/news/1", "https://example.edu/study?page=2", "https://example.edu/a.pdf", "https://example.edu/faculty/graduate", "https://example.edu/apply", "https://example.edu/course/42", "https://example.edu/masters/ai")
_FOLD = "trim(regexp_replace(replace(lower({c}), '-', ' '), '\\s+', ' ', 'g'))"
_POINTS = " + ".join(f"CASE WHEN {has('seen', p)} THEN {w} ELSE 0 END" for _, w, p in (*P.CATALOGUE_SIGNALS, *P.CATALOGUE_NEGATIVE_SIGNALS))
_NAMED = {n: p for n, _, p in P.CATALOGUE_SIGNALS}


@query(f"""WITH c AS (SELECT p_partkey, {pick_sql(_LABELS, "p_partkey")} AS label, {pick_sql(_LINKS, "p_partkey", 2)} AS u FROM part), s AS (SELECT *, regexp_extract(u, '://[^/?#]*([^?#]*)', 1) AS path FROM c), f AS (SELECT *, {_FOLD.format(c="label")} AS said, {_FOLD.format(c="label || ' ' || path")} AS seen,
len(list_filter(string_split(path, '/'), lambda x: x <> '' AND {has(_FOLD.format(c="regexp_replace(x, '[-_]', ' ', 'g')"), P.GENERIC_DIRECTORY_SEGMENT)})) > 0 AS generic FROM s),
r AS (SELECT p_partkey, ({_POINTS} + CASE WHEN generic THEN 2 ELSE 0 END)::INT AS score, label, path, {" OR ".join(has("seen", _NAMED[n]) for n in ("master-level", "postgraduate-level", "graduate-level"))} AS level, generic OR {" OR ".join(f"({has('seen', _NAMED[n])} AND {has('said', _NAMED[n])})" for n in ("catalogue", "programme-list"))} AS directory FROM f)
SELECT p_partkey, score, CASE WHEN length(label) > 240 THEN 'anchor-label-too-long' WHEN {has("path", P.CATALOGUE_REJECT_PATH)} THEN 'rejected-path' WHEN NOT level THEN 'missing-degree-level-signal' WHEN NOT directory THEN 'missing-directory-signal' WHEN score < 6 THEN 'below-score-threshold' ELSE 'accepted' END AS reason FROM r""")
def catalogue_links(spark, d):
    found = ladders.catalogue_link(pick(_LABELS, "p_partkey"), pick(_LINKS, "p_partkey", 2))
    return parquet(spark, d, "part").select("p_partkey", found.alias("x")).select("p_partkey", "x.score", "x.reason")


_L = {n: has("said", p) for n, p in (("degree", P.LINK_DEGREE_WORDS), ("programme", P.LINK_PROGRAMME_WORDS), ("related", P.LINK_RELATED_WORDS))}


@query(rf"""WITH c AS (SELECT p_partkey, {pick_sql(_LABELS, "p_partkey")} AS label, {pick_sql(_LINKS, "p_partkey", 2)} AS u FROM part), s AS (SELECT *, regexp_extract(u, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(u, '^[^?#]*\?([^#]*)', 1) AS query FROM c), t AS (SELECT *, path || '?' || query AS pt FROM s),
f AS (SELECT *, label || ' ' || pt AS said, starts_with(u, 'https://example.edu/masters/') AND length(u) > 28 AS pre, {has("path", P.LINK_OPAQUE_PROGRAM_PATH)} AS opaque FROM t),
g AS (SELECT *, {_L["degree"]} AS degree, {_L["programme"]} AS programme, {_L["related"]} AS related, opaque OR {has("pt", P.LINK_PROGRAM_PATH)} AS detail, {has("said", P.LINK_CATEGORY_WORDS)} OR {has("pt", P.LINK_CATEGORY_PATH)} AS category, {has("label", P.LINK_PAGINATION_TEXT)} OR starts_with(query, 'page=') AS pages FROM f),
k AS (SELECT *, CASE WHEN {has("path", P.LINK_ASSET_PATH)} OR u = 'https://example.edu/masters' OR {has("said", P.LINK_NON_PROGRAM_SIGNAL)} OR {has("pt", P.LINK_REJECT_PATH)} OR ({has("said", P.LINK_REJECT_WORDS)} AND NOT degree) THEN NULL WHEN pages THEN 'pagination' WHEN (related AND NOT degree) OR ({has("said", P.LINK_WRONG_LEVEL)} AND NOT {has("label", P.LINK_DEGREE_WORDS)}) THEN NULL
WHEN opaque AND length(label) >= 5 THEN 'program' WHEN degree AND (detail OR pre) THEN 'program' WHEN pre AND NOT {has("path", P.LINK_GENERIC_CATEGORY)} THEN 'program' WHEN category AND (degree OR programme) THEN 'category' WHEN degree AND len(list_filter(string_split(path, '/'), lambda x: x <> '')) >= 1 THEN 'category' END AS kind FROM g)
SELECT p_partkey, kind, CASE WHEN kind IS NULL THEN NULL WHEN kind = 'pagination' THEN 20 ELSE degree::INT * 7 + programme::INT * 4 + detail::INT * 5 + pre::INT * 5 + category::INT * 2 - related::INT * 3 END::INT AS score FROM k""")
def page_links(spark, d):
    """Links of one page as programmes, categories and further pages."""
    found = ladders.page_link(pick(_LABELS, "p_partkey"), pick(_LINKS, "p_partkey", 2), F.lit("https://example.edu/masters"), F.array(F.lit("https://example.edu/masters/")), F.lit(""))
    return parquet(spark, d, "part").select("p_partkey", found.alias("x")).select("p_partkey", "x.kind", "x.score")


_TYPE = ladder_sql([(n, has("said", p)) for n, p in ladders.EVIDENCE_TYPES], "application")


@query(f"""WITH c AS (SELECT p_partkey, p_size, {pick_sql(_LABELS, "p_partkey")} || ' ' || {pick_sql(_LINKS, "p_partkey", 2)} AS said FROM part), e AS (SELECT p_partkey, p_size, {_TYPE} AS type, CASE WHEN {has("said", "deadline|requirements?|eligibility|documents?")} THEN 4 ELSE 0 END + CASE WHEN {has("said", "apply|application|admission")} THEN 2 ELSE 0 END AS score FROM c WHERE {has("said", P.LINK_RELATED_WORDS)} AND NOT {has("said", P.LINK_WRONG_LEVEL)}),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY p_size, type ORDER BY score DESC, p_partkey) = 1) SELECT p_size, type, score::INT AS score, p_partkey FROM b QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY list_position(['deadline', 'requirements', 'documents', 'language', 'application'], type)) <= 3""")
def evidence_links(spark, d):
    """The best link of each type of evidence, at most three types a page, in a fixed order."""
    said = F.concat_ws(" ", pick(_LABELS, "p_partkey"), pick(_LINKS, "p_partkey", 2))
    rows = parquet(spark, d, "part").select("p_size", "p_partkey", ladders.evidence_link(said).alias("x")).where("x IS NOT NULL").select("p_size", "p_partkey", "x.type", "x.score")
    best = dedup.keep_best(rows, ["p_size", "type"], [F.col("score").desc(), F.col("p_partkey")])
    order = F.array_position(F.array(*map(F.lit, ladders.EVIDENCE_ORDER)), F.col("type"))
    return dedup.top_k(best, ["p_size"], [order], 3).select("p_size", "type", "score", "p_partkey")


@query(f"""WITH c AS (SELECT p_partkey, {pick_sql(_LABELS, "p_partkey")} AS label, {pick_sql(URLS, "p_partkey", 2)} AS u FROM part), s AS (SELECT *, {_SPLIT} FROM c), l AS (SELECT *, lower(label || ' ' || u) AS low FROM s)
SELECT p_partkey, CASE WHEN host = '' OR {_DENIED} THEN -100 ELSE CASE WHEN {_TRUST.format(h="host")} THEN 10 ELSE 0 END + least(4, 2 * len(list_filter(['data', 'graduate', 'example'], lambda t: contains(low, t)))) + CASE WHEN {has("low", "master|msc|graduate|degree.program|study.program")} THEN 4 ELSE 0 END + CASE WHEN {has("low", "admission|apply|application")} THEN 1 ELSE 0 END + CASE WHEN {has("u", "programmes?|degree-programs?|study-programmes?|/masters?/")} THEN 5 ELSE 0 END END::INT AS score FROM l""")
def search_scores(spark, d):
    tokens, domains = (F.array(*map(F.lit, v)) for v in (("data", "graduate", "example"), DOMAINS))
    return parquet(spark, d, "part").select("p_partkey", ladders.search_result_score(pick(_LABELS, "p_partkey"), pick(URLS, "p_partkey", 2), tokens, domains).alias("score"))


_COUNTRIES = ("China (Mainland)", "Hong Kong SAR", "Türkiye", "USA", "Germany", "Italy", "PR China", "People’s Republic of  China", "Ireland", "Norway")
_COUNTRY = "coalesce(MAP {" + ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in rules.COUNTRY_ALIASES.items()) + "}[c], c)"
_REGION = "coalesce(MAP {" + ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in rules.REGIONS.items()) + "}[country], country)"


@query(rf"""WITH n AS (SELECT c_custkey, trim(regexp_replace({pick_sql(_COUNTRIES, "c_custkey")}, '\s+', ' ', 'g')) AS c FROM customer), m AS (SELECT c_custkey, c, {_COUNTRY} AS country, trim(regexp_replace(replace(lower(c), '’', ''''), '\s+', ' ', 'g')) AS k FROM n), g AS (SELECT *, {_REGION} AS region FROM m)
SELECT country, region, region IN ({", ".join(map(quoted, ladders.EUROPE))}) AND country NOT IN ({", ".join(map(quoted, ladders.OUTSIDE_EUROPE_TARGETS))}) AS europe, k IN ({", ".join(map(quoted, ladders.MAINLAND_CHINA))}) AS mainland, count(*) AS n FROM g GROUP BY ALL""")
def country_policy(spark, d):
    """Countries under their published labels, regions, the European selection, and what queues (not rankings) leave out."""
    rows = parquet(spark, d, "customer").select(pick(_COUNTRIES, "c_custkey").alias("c")).withColumn("country", text.country(F.col("c"))).withColumn("region", text.region(F.col("country")))
    return rows.groupBy("country", "region", ladders.is_europe_target(F.col("country"), F.col("region")).alias("europe"), ladders.is_mainland_china(F.col("c")).alias("mainland")).agg(F.count("*").alias("n"))


@query(r"""WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size || '' END AS gpa, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS ielts, CASE WHEN p_partkey % 5 = 0 THEN trim('  ') ELSE '' END AS toefl, CASE WHEN p_partkey % 7 = 0 THEN p_name END AS language FROM part)
SELECT p_partkey, gpa IS NOT NULL OR ielts IS NOT NULL OR language IS NOT NULL AS has, concat_ws(' · ', 'IELTS ' || ielts, 'GPA ' || gpa, language) AS said FROM r""")
def requirement_fields(spark, d):
    """The five requirements as a fixed struct, empty ones null, and the text that pages show for them."""
    k = F.col("p_partkey")
    values = {"gpa": F.when(k % 2 == 0, F.col("p_size").cast("string")), "ielts": F.when(k % 3 == 0, F.col("p_brand")), "toefl": F.when(k % 5 == 0, "  ").otherwise(""), "language": F.when(k % 7 == 0, F.concat(F.lit(" "), "p_name")), "other": F.lit("x")}
    rows = parquet(spark, d, "part").select("p_partkey", ladders.clean_requirements(values).alias("r"))
    return rows.select("p_partkey", ladders.has_requirement(F.col("r")).alias("has"), ladders.requirement_text(F.col("r")).alias("said"))
