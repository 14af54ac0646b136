"""Functions over cases whose results are known, dealt out over whole tables, and the checks of stores and boards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.functions import dates, rules, scores, text, urls
from tarnlake.operators import audit, dedup, ladders, ranking
from tarnlake.plans.registry import pick, pick_sql, registry
from tarnlake.sources.readers import parquet
from tarnlake.streaming import state

QUERIES: dict = {}
ORACLES: dict = {}
query = registry(QUERIES, ORACLES)


def _cases(spark, d, values):
    return parquet(spark, d, "part").select("p_partkey", pick(values, "p_partkey").alias("v"))


def _expected(**columns):
    return "SELECT p_partkey, " + ", ".join(f"{pick_sql(v, 'p_partkey')} AS {k}" for k, v in columns.items()) + " FROM part"


_NAMES = ("University of Z&uuml;rich (ETH)", "St. Univ. Caf&eacute; & Co", "The Inst. of X -- Y - China", "Œuvre Östersund", "北京 大学 (PKU)", "MIT", "A.B. Tech. (UBA-1)", "")


@query(_expected(
    name=("zurich", "st univ cafe and co", "inst x y", "uvre ostersund", "", "mit", "a b tech", ""),
    alias=("university of zurich eth", "st university cafe co", "institute of x y china", "uvre ostersund", "pku", "mit", "a b tech uba 1", ""),
    token=("university of zurich eth", "st univ cafe and co", "the inst of x y china", "uvre ostersund", "pku", "mit", "a b tech uba 1", ""),
    live=("university of zurich eth", "st univ cafe and co", "the inst of x y china", "œuvre ostersund", "北京 大学 pku", "mit", "a b tech uba 1", ""),
    compact=("universityofzuricheth", "stunivcafeandco", "theinstofxychina", "œuvreostersund", "北京大学pku", "mit", "abtechuba1", ""),
    variants=("university of zurich eth;university of zurich", "st univ cafe and co", "the inst of x y china", "uvre ostersund", "pku", "mit", "a b tech uba 1;a b tech", ""),
    safe=("University_of_Zurich_ETH", "St._Univ._Cafe_Co", "The_Inst._of_X_--_Y_-_China", "uvre_Ostersund", "PKU", "MIT", "A.B._Tech._UBA-1", "unknown"),
    tokens=("eth,zurich", "cafe,co,st,univ", "china,inst", "ostersund,uvre", "pku", "mit", "tech,uba", ""),
))
def name_functions(spark, d):
    """Every name key of one set of names: entities, marks, ligatures, other scripts, abbreviations, acronyms."""
    rows = _cases(spark, d, _NAMES).withColumn("u", text.html_unescape("v")).withColumn("a", text.fold_ascii("u")).withColumn("p", text.strip_marks("u"))
    a, p = F.col("a"), F.col("p")
    return rows.select(
        "p_partkey", text.name_key(a).alias("name"), text.alias_key(a).alias("alias"), text.token_key(p).alias("token"), text.live_key(p).alias("live"), text.compact_key(p).alias("compact"),
        F.array_join(text.name_variants(p), ";").alias("variants"), text.safe_id(p).alias("safe"), F.array_join(text.tokens(p), ",").alias("tokens"),
    )


_TITLES = ("Admission to the Master's programme in Robotics", "  MSc ­Data​ Science ", "<b>ETH</b>  Z&uuml;rich", "Ã‰cole", "=12", "601-800", "rank 7th", "")


@query(_expected(
    programme=("Robotics", "MSc ­Data​ Science", "<b>ETH</b> Z&uuml;rich", "Ã‰cole", "=12", "601-800", "rank 7th", ""),
    clean=("Admission to the Master's programme in Robotics", "MSc Data Science", "<b>ETH</b> Z&uuml;rich", "Ã‰cole", "=12", "601-800", "rank 7th", ""),
    plain=("Admission to the Master's programme in Robotics", "MSc ­Data​ Science", "ETH  Zürich", "Ã‰cole", "=12", "601-800", "rank 7th", ""),
    repaired=("Admission to the Master's programme in Robotics", "  MSc ­Data​ Science ", "<b>ETH</b>  Z&uuml;rich", "École", "=12", "601-800", "rank 7th", ""),
    number=(None, None, None, None, 12, 601, 7, None),
))
def title_functions(spark, d):
    v = F.col("v")
    rows = _cases(spark, d, _TITLES)
    return rows.select("p_partkey", text.programme_title(v).alias("programme"), text.clean_title(v).alias("clean"), text.html_unescape(text.plain_text(v)).alias("plain"), text.repair_mojibake("v").alias("repaired"), text.first_int(v).alias("number"))


_URLS = ("HTTPS://WWW.Example.edu:443/a/&utm_source=x", "http://example.edu:80/a/b/?utm_medium=1&k=2#t", "https://www2.sub.example.ac.uk/x", "https://linkedin.com.example.org/", "ftp://a.b/c", "https://x.wikipedia.org/wiki", "https://example.com/a%20b?q=%C3%A9", "nonsense")


@query(_expected(
    queue=("https://www.example.edu/a/", "http://example.edu/a/b/?k=2", "https://www2.sub.example.ac.uk/x", "https://linkedin.com.example.org/", "ftp://a.b/c", "https://x.wikipedia.org/wiki", "https://example.com/a%20b?q=%C3%A9", ""),
    batch=("https://www.example.edu/a/&utm_source=x", "http://example.edu/a/b/?utm_medium=1&k=2", "https://www2.sub.example.ac.uk/x", "https://linkedin.com.example.org/", "ftp://a.b/c", "https://x.wikipedia.org/wiki", "https://example.com/a%20b?q=%C3%A9", ""),
    low=("https://www.example.edu:443/a/&utm_source=x", "http://example.edu:80/a/b/?utm_medium=1&k=2", "https://www2.sub.example.ac.uk/x", "https://linkedin.com.example.org", "ftp://a.b/c", "https://x.wikipedia.org/wiki", "https://example.com/a%20b?q=%c3%a9", "nonsense"),
    fixed=("HTTPS://WWW.Example.edu:443/a/", "http://example.edu:80/a/b/?utm_medium=1&k=2#t", "https://www2.sub.example.ac.uk/x", "https://linkedin.com.example.org/", "ftp://a.b/c", "https://x.wikipedia.org/wiki", "https://example.com/a%20b?q=%C3%A9", "nonsense"),
    host=("example.edu", "example.edu", "www2.sub.example.ac.uk", "linkedin.com.example.org", "a.b", "x.wikipedia.org", "example.com", ""),
    base=("example.edu", "example.edu", "sub.example.ac.uk", "linkedin.com.example.org", "a.b", "x.wikipedia.org", "example.com", ""),
    site=("example.edu", "example.edu", "example.ac.uk", "example.org", "a.b", "wikipedia.org", "example.com", ""),
    signal=("example.edu /a/&utm_source=x ", "example.edu /a/b/ utm_medium=1&k=2", "www2.sub.example.ac.uk /x ", "linkedin.com.example.org / ", "a.b /c ", "x.wikipedia.org /wiki ", "example.com /a b q=é", "  "),
    denied=(False, False, False, False, False, True, False, False),
    web=(True, True, True, True, False, True, True, False),
    related=(True, True, False, False, False, False, False, False),
    path_depth=(2, 2, 1, 0, 1, 1, 1, 0),
))
def url_functions(spark, d):
    """Every normal form of one set of urls; the forms differ on purpose."""
    v = F.col("v")
    return _cases(spark, d, _URLS).select(
        "p_partkey", urls.queue_url(v).alias("queue"), urls.batch_url(v).alias("batch"), urls.lower_key(v).alias("low"), urls.untracked_path(v).alias("fixed"), urls.host(v).alias("host"), urls.base_host(v).alias("base"),
        urls.registrable(urls.base_host(v)).alias("site"), urls.signal_text(v).alias("signal"), urls.denied(v).alias("denied"), urls.is_web(v).alias("web"), urls.related(urls.host(v), F.lit("sub.example.edu")).alias("related"), urls.depth(v).alias("path_depth"),
    )


_NUMBERS = ("50.5", "N/A", "", "-", "101", "100", " 7 ", "-1")
_MATERIALS = ("CV", "letter of  motivation", "GRE", "bachelor", "Essay", "", "English proof (B2)", "2 references")


@query(_expected(
    score=(50.5, None, None, None, None, 100.0, 7.0, None), seen=("CV", "Motivation letter", None, None, "Essay", None, "English proof", "Recommendation letter"), sure=("CV", "Motivation letter", "GRE", "bachelor", "Essay", None, "English proof", "Recommendation letter"),
))
def value_functions(spark, d):
    """Scores in their range, and materials under their published names, verified or not."""
    m = pick(_MATERIALS, "p_partkey")
    return _cases(spark, d, _NUMBERS).select("p_partkey", scores.score(F.col("v")).alias("score"), text.material(m, F.lit(False)).alias("seen"), text.material(m, F.lit(True)).alias("sure"))


_COUNTRIES = ("United States of America", "China-Hong Kong", "Türkiye", "GB", "Republic of Korea", "Hong Kong  SAR", "Italy", "Taiwan, Province of China")


@query(_expected(
    published=("United States of America", "China-Hong Kong", "Turkey", "GB", "Republic of Korea", "Hong Kong", "Italy", "Taiwan, Province of China"),
    alias=("United States", "China-Hong Kong", "Türkiye", "GB", "Republic of Korea", "Hong Kong", "Italy", "Taiwan, Province of China"),
    target=("United States of America", "Hong Kong", "Turkey", "GB", "Republic of Korea", "Hong Kong SAR", "Italy", "Taiwan, Province of China"),
    registry=("united states", "china-hong kong", "turkey", "united kingdom", "south korea", "hong kong", "italy", "taiwan"),
))
def country_aliases(spark, d):
    """The four alias tables, which differ on purpose."""
    v = F.col("v")
    rows = _cases(spark, d, _COUNTRIES).withColumn("p", text.ascii_only(v, text.strip_marks))
    return rows.select("p_partkey", text.country(v).alias("published"), text.country(v, rules.ALIAS_COUNTRIES).alias("alias"), text.country(v, rules.TARGET_COUNTRIES).alias("target"), text.registry_country(F.col("p")).alias("registry"))


@query("""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE datediff('hour', TIMESTAMP '1998-06-01 06:00:00', o_orderdate) END AS h FROM orders), y AS (SELECT o_orderkey, ceil(h / 24.0)::INT AS d FROM x)
SELECT o_orderkey, CASE WHEN d IS NULL THEN 'dim' WHEN d < 0 THEN 'bad' WHEN d <= 21 THEN 'soon' ELSE 'ok' END AS tone, CASE WHEN d IS NULL THEN '-' WHEN d < 0 THEN '过期 ' || -d || 'd' WHEN d = 0 THEN '今日截止' WHEN d = 1 THEN '明日截止' WHEN d <= 30 THEN d || 'd' ELSE d // 30 || 'mo' END AS label FROM y""")
def countdowns(spark, d):
    """Days left, part days counted whole, their tone and label."""
    day = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate"))
    days = dates.days_until(day, F.lit("1998-06-01 06:00:00").cast("timestamp_ntz"))
    return parquet(spark, d, "orders").select("o_orderkey", dates.tone(days).alias("tone"), dates.countdown(days).alias("label"))


@query("""WITH e AS (SELECT user_id, event_id, event_type = 'error' AS c FROM events), s AS (SELECT user_id, min(event_id) AS stop FROM e WHERE c AND event_id > 1000 GROUP BY 1) SELECT e.user_id, count(*) AS pages, max(event_id) AS last FROM e LEFT JOIN s USING (user_id) WHERE stop IS NULL OR event_id < stop GROUP BY 1""")
def until_gate(spark, d):
    """Pages of each institution before the first gate; those after it were not looked at."""
    rows = parquet(spark, d, "events").select("user_id", "event_id", ((F.col("event_type") == "error") & (F.col("event_id") > 1000)).alias("gate"))
    return state.until_first(rows, ["user_id"], "event_id", "gate").groupBy("user_id").agg(F.count("*").alias("pages"), F.max("event_id").alias("last"))


@query("""WITH r AS (SELECT c_custkey % 50 AS owner, CASE WHEN c_custkey % 4 = 0 THEN 'http' ELSE 'https' END || '://www.e' || c_custkey % 50 || '.org/p' || c_custkey % 300 AS url, c_nationkey AS score, CASE WHEN c_custkey % 2 = 0 THEN 'Title ' || c_custkey % 6 END AS title FROM customer UNION ALL SELECT c_custkey % 50, 'https://shared.org/x', 99, NULL FROM customer),
f AS (SELECT *, regexp_replace(url, '^https?://(www\\.)?', '') AS fp FROM r), o AS (SELECT * FROM f WHERE fp NOT IN (SELECT fp FROM f GROUP BY fp HAVING min(owner) <> max(owner)) QUALIFY row_number() OVER (PARTITION BY owner, fp ORDER BY score DESC, starts_with(url, 'https:') DESC, length(url), url) = 1),
t AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY owner, coalesce('t:' || lower(title), 'f:' || fp) ORDER BY score DESC, starts_with(url, 'https:') DESC, length(url), url) = 1) SELECT owner, url, score FROM t QUALIFY row_number() OVER (PARTITION BY owner ORDER BY score DESC, starts_with(url, 'https:') DESC, length(url), url) <= 3""".replace("\\\\", "\\"))
def selected_urls(spark, d):
    """Up to three urls of each institution: none that several have, one of each page and of each catalogue title."""
    k = F.col("c_custkey")
    n = lambda m: (k % m).cast("string")
    rows = parquet(spark, d, "customer").select((k % 50).alias("owner"), F.concat(F.when(k % 4 == 0, "http").otherwise("https"), F.lit("://www.e"), n(50), F.lit(".org/p"), n(300)).alias("url"), F.col("c_nationkey").alias("score"), F.when(k % 2 == 0, F.concat(F.lit("Title  "), n(6))).alias("title"))
    rows = rows.union(parquet(spark, d, "customer").select(k % 50, F.lit("https://shared.org/x"), F.lit(99), F.lit(None).cast("string")))
    return dedup.select_urls(rows, "owner", "url", "score", urls.fingerprint(F.col("url")), F.col("title")).select("owner", "url", "score")


@query("""WITH b AS (SELECT c_custkey AS k, 1 + c_custkey % 97 AS rank FROM customer UNION ALL SELECT c_custkey, 1 + c_custkey % 89 FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 1 + c_custkey % 83 FROM customer WHERE c_custkey % 5 = 0), m AS (SELECT k, count(*) AS boards, avg(rank) AS mean_rank FROM b GROUP BY k HAVING count(*) >= 2)
SELECT k, boards, mean_rank FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY k // 40 ORDER BY mean_rank, k) = 1) ORDER BY mean_rank, k LIMIT 6""")
def featured_by_name(spark, d):
    """The six best by mean rank on two boards or more, one of each name."""
    c, k = parquet(spark, d, "customer"), F.col("c_custkey")
    board = lambda m, w: c.where(k % w == 0).select(k.alias("k"), (1 + k % m).alias("rank"))
    names = c.select(k.alias("k"), F.concat(F.lit("University of N"), F.floor(k / 40).cast("string")).alias("name"))
    return ranking.featured(board(97, 1).union(board(89, 3)).union(board(83, 5)), names, "k", 2, 6, text.site_key(F.col("name"))).select("k", "boards", "mean_rank")


@query("""WITH r AS (SELECT o_orderpriority AS source, o_custkey AS id, 'N' || o_custkey AS name, CASE WHEN o_orderkey % 2 = 0 THEN 'Italy' WHEN o_orderkey % 3 = 0 THEN 'Atlantis' ELSE '' END AS country FROM orders), p AS (SELECT *, list_position(['5-LOW', '1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED'], source) AS p FROM r),
o AS (SELECT id, min(name) AS name, coalesce(arg_min(country, (p, country)) FILTER (country <> ''), '') AS country FROM p GROUP BY id), s AS (SELECT id, string_agg(source, ',' ORDER BY p) AS sources FROM (SELECT DISTINCT id, source, p FROM p) GROUP BY id) SELECT id, name, country, CASE country WHEN 'Italy' THEN 'Southern Europe' ELSE country END AS region, sources FROM o JOIN s USING (id)""")
def board_universities(spark, d):
    """One row per institution of all boards: the first country that is known, its region, its boards in order."""
    k = F.col("o_orderkey")
    rows = parquet(spark, d, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_custkey").cast("string").alias("id"), F.concat(F.lit("N"), F.col("o_custkey").cast("string")).alias("name"), F.when(k % 2 == 0, "Italy").when(k % 3 == 0, "Atlantis").otherwise("").alias("country"))
    out = ranking.universities(rows, ["5-LOW", "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"], text.region(F.col("country")))
    return out.select(F.col("id").cast("long").alias("id"), "name", "country", "region", F.array_join("sources", ",").alias("sources"))


_STORE_TITLES = ("MSc Robotics", "Cookies", "Bachelor of Law", "abc")
_STORE_URLS = ("https://e.org/x", "https://else.org/y", "https://www.usnews.com/z")


@query(f"""WITH p AS (SELECT o_orderkey - CASE WHEN o_orderkey % 50 = 1 THEN 1 ELSE 0 END AS id, o_custkey AS u, o_orderkey AS k, {pick_sql(_STORE_TITLES, "o_orderkey")} AS t, {pick_sql(_STORE_URLS, "o_orderkey", 5)} AS url FROM orders), c AS (SELECT c_custkey AS u FROM customer WHERE c_custkey % 8 <> 0),
v AS (SELECT 'orphan' AS rule, CAST(id AS VARCHAR) AS key FROM p WHERE u NOT IN (SELECT u FROM c) UNION ALL SELECT 'non-program', CAST(id AS VARCHAR) FROM p WHERE t <> 'MSc Robotics' OR url LIKE '%usnews%' UNION ALL SELECT 'domain-mismatch', CAST(id AS VARCHAR) FROM p WHERE url <> 'https://e.org/x' UNION ALL SELECT 'non-iso-deadline', CAST(id AS VARCHAR) FROM p WHERE k % 6 = 0
UNION ALL SELECT 'past-deadline', CAST(id AS VARCHAR) FROM p WHERE k % 6 = 1 UNION ALL SELECT 'warning-no-detail', CAST(id AS VARCHAR) FROM p WHERE k % 9 = 0 UNION ALL SELECT 'duplicate-id', CAST(id AS VARCHAR) FROM p GROUP BY id HAVING count(*) > 1) SELECT rule, count(*) AS violations, min(key) AS first_key FROM v GROUP BY rule""")
def store_gate(spark, d):
    """The rules of the published store."""
    k = F.col("o_orderkey")
    title, url = pick(_STORE_TITLES, "o_orderkey"), pick(_STORE_URLS, "o_orderkey", 5)
    due = F.when(k % 6 == 0, F.array(F.lit("June 2030"))).when(k % 6 == 1, F.array(F.lit("2030-01-01"), F.lit("2020-01-01"))).otherwise(F.array(F.lit("2030-01-01")))
    p = parquet(spark, d, "orders").select((k - F.when(k % 50 == 1, 1).otherwise(0)).alias("id"), F.col("o_custkey").alias("university_id"), title.alias("title"), url.alias("url"), due.alias("deadlines"), (k % 9).alias("details"))
    known = parquet(spark, d, "customer").where("c_custkey % 8 <> 0").select(F.col("c_custkey").alias("id"))
    return audit.summary(audit.store_gate(p, known, ladders.non_programme_reason(F.col("title"), F.col("url"), strict=True), urls.belongs(urls.host(F.col("url")), F.lit("e.org")), F.lit("2024-01-01").cast("date")))


@query("WITH r AS (SELECT o_orderpriority AS source, o_orderkey % 100 AS rank, CASE WHEN o_orderkey % 500 <> 0 THEN o_custkey END AS id FROM orders), p AS (SELECT source, rank, count(*) AS n, count(*) - count(id) AS m FROM r GROUP BY ALL) SELECT source, sum(n)::BIGINT AS rows, sum(m)::BIGINT AS missing_ids, count(*) FILTER (n > 1) AS shared_ranks, sum(n) = 3000 AND sum(m) = 0 AS ok FROM p GROUP BY source")
def board_check(spark, d):
    k = F.col("o_orderkey")
    return audit.rankings_check(parquet(spark, d, "orders").select(F.col("o_orderpriority").alias("source"), (k % 100).alias("rank"), F.when(k % 500 != 0, F.col("o_custkey").cast("string")).alias("id")), 3000)


@query("WITH b AS (SELECT o_orderpriority AS source, o_custkey AS k FROM orders), g AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 7 <> 0), p AS (SELECT k, count(DISTINCT source) AS s, count(*) AS n FROM b GROUP BY k) SELECT sum(n)::BIGINT AS rows, count(p.k) AS keys, count(*) FILTER (s > 1) AS on_several, count(*) FILTER (g.k IS NULL) AS only_boards, count(*) FILTER (p.k IS NULL) AS only_goal FROM p FULL JOIN g ON p.k = g.k")
def dedup_check(spark, d):
    boards = parquet(spark, d, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("k"))
    return audit.dedup_check(boards, parquet(spark, d, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("k")), "k")


@query("SELECT o_orderkey % 14000 AS raw, min(o_custkey) AS cid FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1 HAVING min(o_custkey) = max(o_custkey)")
def inverted_map(spark, d):
    """Ids of targets back to institutions; ids of several institutions resolve to none."""
    return dedup.unambiguous(parquet(spark, d, "orders").where("o_orderkey % 3 <> 0").select((F.col("o_orderkey") % 14000).alias("raw"), F.col("o_custkey").alias("cid")), "raw", "cid")
