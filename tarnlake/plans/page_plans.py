"""Url, text, evidence, classifier, audit and serving queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.functions import dates, rules, text, urls
from tarnlake.operators import audit, dedup, evidence, joins
from tarnlake.plans.registry import registry
from tarnlake.sources.readers import parquet

QUERIES: dict = {}
ORACLES: dict = {}
query = registry(QUERIES, ORACLES)

# Evidence of this corpus: categories and patterns that mean the same in all regular expression dialects.
CORPUS_SIGNALS = {"articles": "(^|[^a-z])(the|der|la|el)([^a-z]|$)", "numbers": "[0-9]{3,}", "secrets": "token|password|secret", "bars": r" \| "}
CORPUS_TERMS = (("en", "the", 5), ("en", "that", 3), ("de", "und", 5), ("fr", "les", 4), ("es", "los", 4), ("noise", "buy", 2))

_PARTS = r"""scheme AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS n, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p,
array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(string_split(x, '=')[1], '(?i)^(?:utm_.+|fbclid|gclid|mc_cid|mc_eid|ref|source)$')), '&') AS q FROM pages)"""


@query(r"""SELECT p_partkey, 'u_' || lower(regexp_replace(regexp_replace(regexp_replace(p_name || ' (X) ' || p_type, '[^\w\s-]', '', 'g'), '[\s\-]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug,
trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS folded, left(regexp_replace(regexp_replace(lower(p_brand || p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 40) AS short FROM part""")
def slug_and_fold(spark, d):
    name = F.concat(F.col("p_name"), F.lit(" (X) "), F.col("p_type"))
    return parquet(spark, d, "part").select("p_partkey", text.slug(name).alias("slug"), text.fold_search(F.concat_ws(" ", "p_name", "p_brand")).alias("folded"), text.short_slug(F.concat("p_brand", "p_name")).alias("short"))


@query()
def name_keys(spark, d):
    rows = parquet(spark, d, "documents").select("doc_id", F.col("text").alias("t")).withColumn("ascii", text.fold_ascii(text.html_unescape("t"))).withColumn("plain", text.strip_marks("t"))
    return rows.select("doc_id", text.name_key(F.col("ascii")).alias("name_key"), text.alias_key(F.col("ascii")).alias("alias_key"), text.token_key(F.col("plain")).alias("token_key"), text.compact_key(F.col("plain")).alias("compact_key"))


@query(rf"WITH {_PARTS} SELECT page_id, s || '://' || n || CASE WHEN p = '/' THEN p ELSE regexp_replace(p, '/+$', '') END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS url_key FROM scheme")
def url_key(spark, d):
    return parquet(spark, d, "pages").select("page_id", urls.url_key(F.col("url")).alias("url_key"))


@query(r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') AS host, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\d*\.', '') AS base, len(list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> ''))::INT AS depth FROM pages")
def host_of(spark, d):
    u = F.col("url")
    return parquet(spark, d, "pages").select("page_id", urls.host(u).alias("host"), urls.base_host(u).alias("base"), urls.depth(u).alias("depth"))


@query(r"WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\.', '') AS host FROM pages), d AS (SELECT unnest(['example.com', 'example.net', 'blog.example.org', 'org']) AS domain) SELECT domain, count(*) AS pages FROM h JOIN d ON host = domain OR ends_with(host, '.' || domain) GROUP BY domain")
def domain_contains(spark, d):
    domains = spark.createDataFrame([(x,) for x in ("example.com", "example.net", "blog.example.org", "org")], "name string")
    pages = parquet(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    return joins.within_domains(pages, "host", domains, "name").groupBy("domain").agg(F.count("*").alias("pages"))


@query(rf"WITH {_PARTS}, f AS (SELECT page_id, regexp_replace(n, '^www\.', '') || '|' || regexp_replace(lower(url_decode(p)), '/+$', '') || '|' || lower(url_decode(regexp_extract(url, '^[^?#]*\?([^#]*)', 1))) AS fingerprint FROM scheme) SELECT page_id, fingerprint FROM f WHERE fingerprint IN (SELECT fingerprint FROM f GROUP BY 1 HAVING min(page_id) = max(page_id))")
def url_single_owner(spark, d):
    rows = parquet(spark, d, "pages").select("page_id", urls.fingerprint(F.col("url")).alias("fingerprint"))
    return dedup.single_owner(rows, "fingerprint", "page_id")


@query(rf"WITH {_PARTS}, f AS (SELECT page_id, regexp_replace(n, '^www\.', '') AS fingerprint FROM scheme) SELECT fingerprint, count(*) AS pages, min(page_id) AS first_page FROM f GROUP BY 1 HAVING count(*) > 1")
def url_collisions(spark, d):
    rows = parquet(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("fingerprint"))
    return rows.groupBy("fingerprint").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page")).where("pages > 1")


@query(r"""WITH b AS (SELECT page_id, html, regexp_extract(html, '(?is)<body\b[^>]*>(.*?)</body\s*>', 1) AS body FROM pages), c AS (SELECT page_id, CASE WHEN body = '' THEN html ELSE body END AS t FROM b),
s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '(?is)<noscript\b[^>]*>.*?</noscript\s*>', ' ', 'g'), '(?is)<svg\b[^>]*>.*?</svg\s*>', ' ', 'g'), '(?is)<template\b[^>]*>.*?</template\s*>', ' ', 'g') AS t FROM c)
SELECT page_id, length(trim(regexp_replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')))::INT AS n FROM s""")
def visible_text_len(spark, d):
    return parquet(spark, d, "pages").select("page_id", F.length(text.visible_text(F.col("html"))).alias("n"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1))::INT AS links, len(list_filter(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1), lambda u: starts_with(u, 'http')))::INT AS outside, len(list_distinct(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)))::INT AS different FROM pages""")
def extract_links(spark, d):
    rows = parquet(spark, d, "pages").select("page_id", F.expr(r"""regexp_extract_all(html, r'<a\s[^>]*href="([^"]*)"', 1)""").alias("u"))
    return rows.select("page_id", F.size("u").alias("links"), F.size(F.filter("u", lambda x: F.startswith(x, F.lit("http")))).alias("outside"), F.size(F.array_distinct("u")).alias("different"))


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(text, '(?i){p}') AS {k}" for k, p in CORPUS_SIGNALS.items()) + " FROM documents")
def signal_detection(spark, d):
    return parquet(spark, d, "documents").select("doc_id", *(c.alias(k) for k, c in evidence.signals(F.col("text"), CORPUS_SIGNALS).items()))


@query("WITH s AS (" + " UNION ALL ".join(f"SELECT lang, source, '{k}' AS category, regexp_matches(text, '(?i){p}') AS has FROM documents" for k, p in CORPUS_SIGNALS.items()) + ") SELECT lang, source, category, count(*) AS total, count(*) FILTER (has) AS covered, round_even(count(*) FILTER (has) / count(*), 4) AS rate, bool_or(has) AS has_any, bool_and(has) AS has_full FROM s GROUP BY ALL")
def signal_coverage(spark, d):
    rows = parquet(spark, d, "documents").select("lang", "source", *(c.alias(k) for k, c in evidence.signals(F.col("text"), CORPUS_SIGNALS).items()))
    return evidence.coverage(rows, ["lang", "source"], list(CORPUS_SIGNALS))


@query()
def admission_signals(spark, d):
    rows = parquet(spark, d, "pages").select("page_id", text.visible_text(F.col("html")).alias("t"))
    return rows.select("page_id", *(c.alias(k) for k, c in evidence.signals(F.col("t")).items()), evidence.weighted(F.col("t")).alias("weight"), evidence.captcha(F.col("t")).alias("gated"), evidence.platform(F.col("t")).alias("platform"))


@query("WITH s AS (SELECT doc_id, " + " + ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN {w} ELSE 0 END" for _, t, w in CORPUS_TERMS) + " AS score FROM documents) SELECT doc_id, score, CASE WHEN score >= 12 THEN 'strong' WHEN score >= 5 THEN 'moderate' WHEN score > 0 THEN 'weak' ELSE 'none' END AS level FROM s")
def weighted_signal_score(spark, d):
    rows = parquet(spark, d, "documents").select("doc_id", evidence.weighted(F.col("text"), CORPUS_TERMS).alias("score"))
    return rows.withColumn("level", evidence.level(F.col("score")))


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(lower(p_name || ' ' || p_type || ' data'[1:p_partkey % 6]), '{p}') THEN '{s}'" for s, p in rules.SUBJECTS) + " ELSE 'General' END AS subject FROM part")
def classify_ladder(spark, d):
    t = F.lower(F.concat(F.col("p_name"), F.lit(" "), F.col("p_type"), F.expr("left(' data', cast(p_partkey % 6 AS int))")))
    return parquet(spark, d, "part").select("p_partkey", evidence.first_match(t, rules.SUBJECTS, "General").alias("subject"))


@query(r"""WITH t AS (SELECT page_id, url, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title FROM pages) SELECT reason, count(*) AS n FROM (SELECT CASE WHEN length(title) < 4 THEN 'empty-title' WHEN regexp_matches(title, '(?i)cookie|privacy|404') THEN 'category-or-information-page' WHEN regexp_matches(title, '###|&&&') THEN 'noise' WHEN NOT regexp_matches(url, '^https?://[^/]+') THEN 'invalid-source-url' WHEN regexp_matches(url, '://[^/]*example\.net') THEN 'third-party-source' ELSE '' END AS reason FROM t) GROUP BY reason""")
def reason_histogram(spark, d):
    rows = parquet(spark, d, "pages").select("url", F.trim(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)).alias("title"))
    t, u = F.col("title"), F.col("url")
    reason = F.when(F.length(t) < 4, "empty-title").when(t.rlike("(?i)cookie|privacy|404"), "category-or-information-page").when(t.rlike("###|&&&"), "noise").when(~urls.is_web(u), "invalid-source-url").when(urls.belongs(urls.host(u), F.lit("example.net")), "third-party-source").otherwise("")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


_STATUS = {"purchase": "captured", "signup": "blocked", "error": "error", "click": "pending", "view": "missing"}


@query("SELECT u AS user_group, arg_max(s, p) AS status FROM (SELECT user_id * 100 + event_id % 100 AS u, " + "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items()) + " END AS s, CASE event_type " + " ".join(f"WHEN '{k}' THEN {rules.PAGE_STATUSES[v]}" for k, v in _STATUS.items()) + " END AS p FROM events) GROUP BY u")
def best_status(spark, d):
    rows = parquet(spark, d, "events").select((F.col("user_id") * 100 + F.col("event_id") % 100).alias("user_group"), text.mapped(F.col("event_type"), _STATUS).alias("status"))
    return evidence.best_status(rows, ["user_group"], "status", rules.PAGE_STATUSES)


@query("SELECT u AS user_group, CASE WHEN bool_or(value > 100) THEN 'blocked' WHEN bool_or(event_type = 'purchase') THEN 'captured' WHEN bool_or(event_type = 'signup') THEN 'blocked' WHEN bool_or(event_type = 'click') THEN 'pending' ELSE 'error' END AS status FROM (SELECT user_id * 100 + event_id % 100 AS u, * FROM events) GROUP BY u")
def merged_status(spark, d):
    rows = parquet(spark, d, "events").select((F.col("user_id") * 100 + F.col("event_id") % 100).alias("user_group"), text.mapped(F.col("event_type"), _STATUS).alias("status"), (F.col("value") > 100).alias("gate"))
    return evidence.merged_status(rows, ["user_group"], "status", "gate")


@query("PIVOT (SELECT source, lang FROM documents) ON lang IN ('en', 'de', 'fr', 'es') USING count(*) GROUP BY source")
def cross_tab(spark, d):
    return parquet(spark, d, "documents").groupBy("source").pivot("lang", ["en", "de", "fr", "es"]).agg(F.count(F.lit(1))).na.fill(0)


@query("""SELECT rule, count(*) AS violations, min(key) AS first_key FROM (SELECT 'orphan-order' AS rule, CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 500)
UNION ALL SELECT 'negative-balance', CAST(c_custkey AS VARCHAR) FROM customer WHERE NOT c_acctbal >= 0 UNION ALL SELECT 'unknown-status', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'duplicate-price', p FROM (SELECT CAST(floor(o_totalprice)::BIGINT AS VARCHAR) AS p FROM orders GROUP BY 1 HAVING count(*) > 1)) GROUP BY rule""")
def violations(spark, d):
    o, c = parquet(spark, d, "orders"), parquet(spark, d, "customer")
    return audit.summary([
        audit.orphans(o, "orphan-order", "o_orderkey", "o_custkey", c.where("c_acctbal > 500"), "c_custkey"),
        audit.failing(c, "negative-balance", "c_custkey", F.col("c_acctbal") >= 0, "c_acctbal"),
        audit.failing(o, "unknown-status", "o_orderkey", F.col("o_orderstatus").isin("F", "O"), "o_orderstatus"),
        audit.duplicates(o.select(F.floor("o_totalprice").cast("long").alias("p")), "duplicate-price", "p"),
    ])


@query(r"""SELECT p_partkey, p_name, p_brand FROM part WHERE p_size BETWEEN 5 AND 45 AND p_type IN ('ECONOMY', 'PROMO') AND contains(trim(regexp_replace(lower(p_name || ' ' || p_brand || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')), 'ring') ORDER BY CASE p_type WHEN 'PROMO' THEN 0 ELSE 1 END, p_name, p_partkey LIMIT 100""")
def search_facets(spark, d):
    """Program search: facets, a folded substring over joined fields, custom order, one page."""
    folded = text.fold_search(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    rows = parquet(spark, d, "part").where(F.col("p_size").between(5, 45) & F.col("p_type").isin("ECONOMY", "PROMO") & F.contains(folded, F.lit("ring")))
    return rows.orderBy(F.when(F.col("p_type") == "PROMO", 0).otherwise(1), "p_name", "p_partkey").limit(100).select("p_partkey", "p_name", "p_brand")


@query("SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY p_type, p_brand")
def facet_counts(spark, d):
    return parquet(spark, d, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, c_mktsegment, next_order, days, CASE WHEN days IS NULL THEN 'none' WHEN days <= 21 THEN 'soon' ELSE 'ok' END AS bucket FROM (SELECT c_custkey, c_mktsegment, arg_min(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderdate >= TIMESTAMP '2000-06-01') AS next_order, datediff('day', DATE '2000-06-01', CAST(min(o_orderdate) FILTER (o_orderdate >= TIMESTAMP '2000-06-01') AS DATE))::INT AS days FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL)""")
def kanban_nearest(spark, d):
    as_of = "2000-06-01"
    due = parquet(spark, d, "orders").where(F.col("o_orderdate") >= F.lit(as_of).cast("timestamp_ntz")).groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("next_order"), F.min("o_orderdate").alias("day"))
    out = parquet(spark, d, "customer").join(due, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("days", dates.days_until(F.col("day").cast("date"), F.lit(as_of).cast("date")))
    return out.select("c_custkey", "c_mktsegment", "next_order", "days", F.when(F.col("days").isNull(), "none").otherwise(F.when(F.col("days") <= 21, "soon").otherwise("ok")).alias("bucket"))


@query("SELECT n_name, count(*) AS customers, count(*) FILTER (c_acctbal > 5000) AS rich, sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END)::BIGINT AS weight FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def home_stats(spark, d):
    rows = parquet(spark, d, "customer").join(parquet(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("customers"), F.count_if(F.col("c_acctbal") > 5000).alias("rich"), F.sum(F.when(F.col("c_mktsegment") == "BUILDING", 2).otherwise(1)).alias("weight"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, sum(CAST(floor(value * 100) AS BIGINT))::BIGINT AS cents FROM events GROUP BY ALL")
def event_windows(spark, d):
    """Tumbling windows, the same on a stream; an extension."""
    from tarnlake.streaming.state import windowed_counts

    return windowed_counts(parquet(spark, d, "events"))


@query()
def package_flatten(spark, d):
    """A package text to rows, its constraints checked."""
    from tarnlake.operators import packages
    from tarnlake.sources.readers import sections

    lines = spark.createDataFrame([("demo.txt", i, t) for i, t in enumerate(packages.EXAMPLE.splitlines())], "file string, line int, text string")
    return packages.violations(packages.tables(sections(lines)))
