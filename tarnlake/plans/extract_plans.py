"""What is read from JSON, HTML and XML, with bodies made of whole test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.functions import dates, extract, scores, text, urls
from tarnlake.plans.registry import pick, pick_sql, registry
from tarnlake.sources import rankings
from tarnlake.sources.readers import parquet

QUERIES: dict = {}
ORACLES: dict = {}
query = registry(QUERIES, ORACLES)


def _payload(df, key, item):
    """One body per key: its rows in order as a JSON list."""
    return df.groupBy(key).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("at", item.alias("v")))), lambda e: e["v"])).alias("list"))


_BOARD = "WITH c AS (SELECT c_mktsegment AS source, c_name AS name, n_name AS country, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS i FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _board(spark, d):
    c = parquet(spark, d, "customer").join(parquet(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_mktsegment").alias("source"), F.col("c_name").alias("name"), F.col("n_name").alias("country"), "c_custkey", F.col("c_custkey").alias("at"))


_SLUG = "'u_' || lower(regexp_replace(name, '[^A-Za-z0-9]+', '', 'g'))"


@query(f"""{_BOARD}, r AS (SELECT *, 1 + c_custkey % 90 AS low, CASE WHEN c_custkey % 3 = 0 THEN 1 + c_custkey % 90 + c_custkey % 7 ELSE 1 + c_custkey % 90 END AS up FROM c WHERE c_custkey % 11 <> 0)
SELECT source, low::INT AS rank, low || CASE WHEN c_custkey % 3 = 0 THEN '-' || up ELSE '' END AS rank_display, up::INT AS rank_upper, {_SLUG} AS university_id, country, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 100) / 2 END AS score FROM r QUALIFY row_number() OVER (PARTITION BY source ORDER BY low, up, i) <= 100""")
def board_intervals(spark, d):
    """A board whose interface gives intervals; rows with ranks that cannot be read are left out."""
    k = F.col("c_custkey")
    low = 1 + k % 90
    said = F.when(k % 11 == 0, "n/a").when(k % 3 == 0, F.concat(low, F.lit("-"), low + k % 7)).otherwise(low.cast("string"))
    item = F.struct(F.col("name").alias("univNameEn"), said.alias("ranking"), F.col("country").alias("region"), F.when(k % 5 == 0, "").otherwise(((k % 100) / 2).cast("string")).alias("score"))
    body = F.concat(F.lit('{"data": {"rankings": '), F.col("list"), F.lit("}}"))
    return rankings.arwu(_payload(_board(spark, d), "source", item).select("source", F.lit(2025).alias("year"), body.alias("body")), 100).select("source", "rank", "rank_display", "rank_upper", "university_id", "country", "score")


@query(f"""{_BOARD} SELECT source, (1 + c_custkey % 700)::INT AS rank_lower, CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE 1 + c_custkey % 700 END::INT AS rank_upper, CASE WHEN c_custkey % 4 = 1 THEN 'openEnded' ELSE 'exact' END AS rank_type, {_SLUG} AS university_id, country FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE WHEN c_custkey % 2 = 0 THEN 900 - c_custkey % 400 ELSE i + 1 END, i) <= 60""")
def board_embedded_state(spark, d):
    """A board whose page embeds its rows in the state of its framework, somewhere inside."""
    k = F.col("c_custkey")
    said = F.concat((1 + k % 700).cast("string"), F.when(k % 4 == 1, "+").otherwise(""))
    item = F.struct(F.when(k % 2 == 0, F.col("name")).alias("name"), F.when(k % 2 == 1, F.col("name")).alias("title"), said.alias("rank"), F.when(k % 2 == 0, 900 - k % 400).alias("rank_order"), F.col("country").alias("location"))
    state = F.concat(F.lit('{"props": {"x": [], "y": [{"rankingsData": {"data": []}}, {"rankingsData": {"data": '), F.col("list"), F.lit("}}]}}"))
    body = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), F.replace(state, F.lit("&"), F.lit("&amp;")), F.lit("</script></html>"))
    return rankings.the(_payload(_board(spark, d), "source", item).select("source", F.lit(2025).alias("year"), body.alias("body")), 60).select("source", "rank_lower", "rank_upper", "rank_type", "university_id", "country")


@query(f"""{_BOARD} SELECT source, (1 + c_custkey % 40)::INT AS rank, {_SLUG} AS university_id, CASE WHEN c_custkey % 6 <> 0 THEN (c_custkey % 90 + 0.5)::DOUBLE END AS score FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY 1 + c_custkey % 40, i) <= 50""")
def board_nodes(spark, d):
    """A board whose file has titles with tags, ranks such as `=12`, and scores that may be no numbers."""
    k = F.col("c_custkey")
    item = F.struct(F.concat(F.lit("<div><a href='/x'>"), "name", F.lit("</a></div>")).alias("title"), F.concat(F.lit("="), (1 + k % 40).cast("string")).alias("rank_display"), F.when(k % 6 == 0, "N/A").otherwise((k % 90 + 0.5).cast("string")).alias("score"), F.col("country").alias("location"))
    body = F.concat(F.lit('{"nodes": '), F.col("list"), F.lit("}"))
    return rankings.qs(_payload(_board(spark, d), "source", item).select("source", F.lit(2025).alias("year"), body.alias("body")), 50).select("source", "rank", "university_id", "score")


@query(f"""{_BOARD} SELECT source, CASE WHEN c_custkey % 3 = 0 THEN 7 + c_custkey % 30 ELSE 1 + c_custkey % 50 END::INT AS rank, {_SLUG} AS university_id, country, CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 70) / 2 END AS score FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE WHEN c_custkey % 3 = 0 THEN 7 + c_custkey % 30 ELSE 1 + c_custkey % 50 END, name) <= 80""")
def board_page_state(spark, d):
    """A board whose result pages assign their state to the window, `undefined` and all; of several snapshots of a page the last counts."""
    k = F.col("c_custkey")
    ranks = F.array(F.struct(F.lit(False).alias("is_ranked"), F.lit("#1").alias("value")), F.struct((k % 3 == 0).alias("is_ranked"), F.concat(F.lit("#"), (7 + k % 30).cast("string")).alias("value")))
    stats = F.array(F.struct(F.lit("Other").alias("label"), F.lit("1").alias("value")), F.struct(F.when(k % 4 == 0, "Global").otherwise("Global Score").alias("label"), ((k % 70) / 2).cast("string").alias("value")))
    item = F.struct(F.col("name"), F.col("country").alias("country_name"), F.concat(F.lit("#"), (1 + k % 50).cast("string")).alias("rank_display"), ranks.alias("ranks"), stats.alias("stats"))
    found = _payload(_board(spark, d), "source", item)
    state = F.concat(F.lit('{"a/global-universities/search/index.js": {"data": {"more": undefined, "items": '), F.col("list"), F.lit("}}}; var later = 1;"))
    page = lambda s, at: found.select("source", F.lit(2025).alias("year"), F.lit(1).alias("page"), F.lit(at).alias("captured_at"), F.concat(F.lit("<script>window['__PAGE_CONTEXT_QUERY_STATE__'] = "), s, F.lit("</script>")).alias("body"))
    pages = page(F.lit("{}"), "20240101").union(page(state, "20250101"))
    return rankings.usnews(pages, 80).select("source", "rank", "university_id", "country", "score")


@query("""WITH c AS (SELECT c_name AS name, max(c_nationkey) AS nation, max(floor(c_acctbal)) AS score FROM customer GROUP BY 1), r AS (SELECT *, rank() OVER (ORDER BY score DESC) AS rank FROM c WHERE score >= 0) SELECT rank::INT AS rank, name, coalesce('Land ' || CASE WHEN nation < 20 THEN nation END, '') AS country, score FROM r""")
def board_table(spark, d):
    """A board of HTML tables by region, merged: the best score of each name, ranked with ties, countries from two lists."""
    c = parquet(spark, d, "customer").withColumn("s", F.floor("c_acctbal"))
    row = lambda s: F.concat(F.lit("<tr class=x><td>1</td><td>&nbsp;"), "c_name", F.lit("</td><td>"), s.cast("string"), F.lit(".0</td><td>"), F.lit("3"), F.lit("</td></tr>"))
    body = lambda s: c.groupBy("c_mktsegment").agg(F.concat(F.lit("<table>"), F.array_join(F.collect_list(row(s)), "\n"), F.lit("</table>")).alias("body"))
    pages = body(F.col("s")).union(body(F.floor(F.col("s") / 2))).select(F.lit("cs").alias("source"), F.lit(2025).alias("year"), "body")
    homes = c.select(F.col("c_name").alias("institution"), F.concat(F.lit("n"), "c_nationkey").alias("countryabbrv"))
    lands = parquet(spark, d, "nation").where("n_nationkey < 20").select(F.concat(F.lit("N"), "n_nationkey").alias("alpha_2"), F.concat(F.lit("Land "), "n_nationkey").alias("name"))
    return rankings.csrankings(pages, homes, lands).select("rank", "name", "country", "score")


_ANCHOR = r"""list_transform(regexp_extract_all(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>|<template\b[^>]*>.*?</template\s*>', ' ', 'g'), '(?is)<a\s[^>]*>.*?</a\s*>'), lambda a: {'h': regexp_extract(a, '(?is)^<a\s[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1), 't': trim(regexp_replace(regexp_replace(a, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))})"""


@query(rf"""WITH a AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS root, unnest({_ANCHOR}) AS x FROM pages) SELECT page_id, root || regexp_replace(x.h, '/+$', '') AS link, x.t AS label, count(*) AS n FROM a WHERE starts_with(x.h, '/') AND NOT regexp_matches(x.h, '[?#%]') GROUP BY ALL""")
def page_link_rows(spark, d):
    """The links of all pages as rows, resolved against their pages; those by absolute path are compared."""
    rows = extract.links(parquet(spark, d, "pages").withColumn("plain", extract.anchors(F.col("html"))))
    by_path = rows.withColumn("h", F.try_element_at(F.transform("plain", lambda a: a["href"]), F.col("position") + 1)).where("startswith(h, '/') AND NOT h RLIKE '[?#%]'")
    return by_path.groupBy("page_id", "link", "label").agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, 'https://example.edu/' || p_partkey AS href, p_name AS text, p_brand || CASE WHEN p_partkey % 2 = 0 THEN ',' || p_type ELSE '' END AS names FROM part""")
def structured_data(spark, d):
    """Programme links and names of organisations in JSON-LD, nested and beside a broken block."""
    k = F.col("p_partkey")
    course = F.struct(F.lit("Course").alias("@type"), F.concat(F.lit("https://example.edu/"), k.cast("string")).alias("url"), F.col("p_name").alias("name"))
    listed = F.to_json(F.struct(F.lit("WebPage").alias("@type"), F.struct(F.array(F.struct(course.alias("item"))).alias("itemListElement")).alias("mainEntity")))
    owner = F.to_json(F.struct(F.array(F.struct(F.lit("CollegeOrUniversity").alias("@type"), F.col("p_brand").alias("name"), F.when(k % 2 == 0, F.col("p_type")).alias("legalName"))).alias("@graph")))
    block = lambda b: F.concat(F.lit('<script type="application/ld+json">'), b, F.lit("</script>"))
    page = F.concat(block(listed), block(F.lit("{broken")), block(owner))
    rows = parquet(spark, d, "part").select("p_partkey", extract.json_ld(page).alias("b"))
    out = rows.select("p_partkey", F.element_at(extract.json_ld_links("b"), 1).alias("x"), extract.organization_names("b").alias("o"))
    return out.select("p_partkey", "x.href", "x.text", F.array_join("o", ",").alias("names"))


@query(r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)) <> '' AS titled, contains(lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)), 'the') AS structured FROM pages""")
def page_identities(spark, d):
    """Whether pages name an accepted name in their title (or elsewhere in their structure)."""
    found = extract.page_identity(F.regexp_replace("html", "(?is)<h1.*?</h1>|<meta[^>]*>", ""), F.array(F.lit("THE")))
    return parquet(spark, d, "pages").select("page_id", found.alias("x")).select("page_id", (F.col("x.title") != "").alias("titled"), F.col("x.structured").alias("structured"))


@query("SELECT conv_id, trim(string_agg(trim(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g')), ' ' ORDER BY turn)) AS text FROM conversations WHERE text <> '' GROUP BY conv_id")
def json_strings(spark, d):
    """All strings of JSON captures, in order: turns of a conversation as parts of a page."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"])
    raw = F.struct(F.element_at("t", 1).alias("documentTitle"), F.slice("t", 2, 100000).alias("mainText"), F.lit(1).alias("other"))
    rows = parquet(spark, d, "conversations").where("text <> ''").groupBy("conv_id").agg(turns.alias("t"))
    return rows.select("conv_id", extract.json_text(F.to_json(F.struct(raw.alias("raw"), F.lit("not this").alias("x")))).alias("text"))


@query("SELECT doc_id, length(text)::INT AS n, sha256(text) AS digest, contains(lang, 'e') AS latin FROM documents WHERE text IS NOT NULL")
def decoded_bodies(spark, d):
    """Bytes in several charsets, named by header, by the page or not at all, read and verified against their manifest."""
    k = F.col("doc_id")
    plain = F.col("text").cast("binary")
    rows = parquet(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "lang", "text", plain.alias("b"), F.when(k % 3 == 0, "utf-8").when(k % 3 == 1, "no-such-charset").alias("c"))
    good = rows.where(scores.verified(F.col("b"), F.octet_length("b"), F.upper(F.sha2("b", 256))))
    got = good.select("doc_id", "lang", extract.decoded("b", "c").alias("t"))
    return got.select("doc_id", F.length("t").alias("n"), F.sha2("t", 256).alias("digest"), F.contains("lang", F.lit("e")).alias("latin"))


@query("SELECT c_nationkey, count(*) AS locations, min('https://x.org/' || c_custkey) AS first, count(*) FILTER (c_custkey % 2 = 0) AS named FROM customer GROUP BY 1")
def sitemap_locations(spark, d):
    """Locations of XML sitemaps, and sitemaps that robots files name on official domains."""
    c = parquet(spark, d, "customer").withColumn("u", F.concat(F.lit("https://x.org/"), F.col("c_custkey")))
    item = F.concat(F.lit("<url><loc> "), "u", F.lit(" </loc><lastmod>2024</lastmod></url>"))
    line = F.concat(F.when(F.col("c_custkey") % 2 == 0, "Sitemap: ").otherwise("sitemap:https://other.net/"), "u")
    body = c.groupBy("c_nationkey").agg(F.array_join(F.collect_list(item), "").alias("x"), F.array_join(F.collect_list(line), "\n").alias("r"))
    xml = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "x", F.lit("</urlset>")).cast("binary")
    got = body.select("c_nationkey", extract.sitemap(xml).alias("s"), F.size(extract.robots_sitemaps(F.col("r"), F.array(F.lit("x.org")))).alias("named"))
    return got.select("c_nationkey", F.size("s.locations").cast("long").alias("locations"), F.array_min("s.locations").alias("first"), F.col("named").cast("long").alias("named"))


_RELATIVE = ("/a/b/", "c?utm_source=x&k=1", "https://WWW.Other.org:8080/p%20q/?ref=1#top", "../up", "mailto:x@y.z", "file.pdf", "?page=2", "//cdn.example.org/x")
_FETCHED = ("https://example.edu/a/b", "https://example.edu/d/c?k=1", "https://www.other.org:8080/p%20q", "https://example.edu/up", "", "https://example.edu/d/file.pdf", "https://example.edu/d/e?page=2", "https://cdn.example.org/x")
# Tracking is told by whole parts of the query here: `ref=1` stays, `utm_source=x` goes.
_ANCHORED = ("https://example.edu/a/b", "https://example.edu/d/c?k=1", "https://www.other.org:8080/p%20q?ref=1", "https://example.edu/up", "", "", "https://example.edu/d/e?page=2", "https://cdn.example.org/x")
_CLEANED = ("/a/b", "c?utm_source=x&k=1", "https://WWW.Other.org:8080/p%20q/?ref=1", "../up", "mailto:x@y.z", "file.pdf", "?page=2", "//cdn.example.org/x")
_USEFUL = (False, False, False, False, False, False, False, False)


@query(f"SELECT p_partkey, {pick_sql(_FETCHED, 'p_partkey')} AS fetched, {pick_sql(_ANCHORED, 'p_partkey')} AS anchored, {pick_sql(_CLEANED, 'p_partkey')} AS cleaned, {pick_sql(_USEFUL, 'p_partkey')} AS useful FROM part")
def resolved_urls(spark, d):
    """Links resolved against their page in the three forms in use, each against what it is known to give."""
    base = F.lit("https://example.edu/d/e")
    rows = parquet(spark, d, "part").select("p_partkey", pick(_RELATIVE, "p_partkey").alias("u"))
    return rows.select("p_partkey", urls.fetch_url("u", base).alias("fetched"), urls.anchor_url(F.col("u"), base).alias("anchored"), urls.clean_url(F.col("u")).alias("cleaned"), urls.is_useful(F.col("u")).alias("useful"))


@query(r"""WITH s AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS s FROM pages), u AS (SELECT host, s[:len(s) - 1] AS g FROM s WHERE len(s) > 0), m AS (SELECT host, min(len(g)) AS n FROM u GROUP BY host),
p AS (SELECT host, i, min(g[i]) = max(g[i]) AS same, min(g[i]) AS v FROM u JOIN m USING (host), range(1, n + 1) AS r(i) GROUP BY ALL), k AS (SELECT host, i, v FROM p x WHERE NOT EXISTS (SELECT 1 FROM p y WHERE y.host = x.host AND y.i <= x.i AND NOT y.same)) SELECT host, 'https://' || host || '/' || string_agg(v, '/' ORDER BY i) || '/' AS prefix FROM k GROUP BY host""")
def host_prefixes(spark, d):
    """The path prefix that all urls of a host share."""
    return urls.prefixes(parquet(spark, d, "pages"), "url")


_PATHS = ("/master/data-science-master", "/en/", "/programmes/master-of-science-in-applied-physics/index.html", "/x/2024-intake", "/news/robotics", "/a/civil_engineering-1234567", "/study")
_TITLES = ("Data Science", "", "Applied Physics", "", "", "Civil Engineering", "Study")
_SITE_TITLES = ("Data Science Master", "En", "Index.html", "", "Robotics", "Civil Engineering 1234567", "Study")


@query(f"SELECT p_partkey, {pick_sql(_TITLES, 'p_partkey')} AS slug_title, {pick_sql(_SITE_TITLES, 'p_partkey')} AS site_title FROM part")
def titles_from_urls(spark, d):
    u = F.concat(F.lit("https://example.edu"), pick(_PATHS, "p_partkey"))
    return parquet(spark, d, "part").select("p_partkey", urls.slug_title(u).alias("slug_title"), urls.title_from_url(u).alias("site_title"))


_NAMES = ("Universität Zürich (ETH)", "The Royal Institute of Technology", "St. Gallen & Co (Main Campus)", "Politecnico di Milano - Italy", "MIT College (USA)", "Universite de Koeln, Germany", "Örebro School | Orebro")
_SITE = ("zurich", "", "st gallen co", "politecnico di milano italy", "mit college", "de koeln germany", "orebro orebro")
_REPORT = ("zurich", "", "st gallen and co", "politecnico di milano italy", "mit", "de koeln germany", "orebro orebro")
_COVER = ("zurich", "", "st gallen co", "politecnico di milano italy", "mit college", "de koln germany", "orebro orebro")
_CANON = ("u_universitat_zurich_eth", "u_the_royal_institute_of_technology", "u_st_gallen_and_co_main_campus", "u_politecnico_di_milano_italy", "u_mit_college_usa", "u_universite_de_koeln_germany", "u_orebro_school_orebro")
_SEMANTIC = ("eth,zurich", "royal,technology", "campus,co,gallen,main,st", "di,italy,milan,polytechnic", "mit,usa", "cologne,germany", "orebro")
_TERM = ("universitat zurich (eth)", "the royal institute of technology", "st. gallen & co (main campus)", "politecnico di milano italy", "mit college (usa)", "universite de koeln, germany", "orebro school | orebro")
_VARIANTS = ("Universität Zürich", "", "", "Politecnico di Milano", "MIT College;MIT College", "Universite de Koeln", "Örebro School")
_LANDS = ("Switzerland", "Sweden", "", "Italy", "USA", "Germany", "Sweden")


@query(f"SELECT c_custkey, {pick_sql(_SITE, 'c_custkey')} AS site, {pick_sql(_REPORT, 'c_custkey')} AS report, {pick_sql(_COVER, 'c_custkey')} AS cover, {pick_sql(_CANON, 'c_custkey')} AS canonical, {pick_sql(_SEMANTIC, 'c_custkey')} AS semantic, {pick_sql(_TERM, 'c_custkey')} AS term, {pick_sql(_VARIANTS, 'c_custkey')} AS variants FROM customer")
def institution_keys(spark, d):
    """The name keys that differ on purpose, each against what it is known to give; marks are stripped in Python only where there are any."""
    rows = parquet(spark, d, "customer").select("c_custkey", pick(_NAMES, "c_custkey").alias("n"), pick(_LANDS, "c_custkey").alias("c"))
    rows = rows.withColumn("plain", text.ascii_only(F.col("n"), text.strip_marks)).withColumn("ascii", text.ascii_only(F.col("n"), text.fold_ascii))
    p = F.col("plain")
    variants = F.array_join(F.transform(text.query_variants(F.col("n"), F.col("c")), lambda v: v["name"]), ";")
    return rows.select(
        "c_custkey", text.site_key(p).alias("site"), text.report_key(F.col("ascii")).alias("report"), text.coverage_key(p).alias("cover"), text.canonical_slug(p).alias("canonical"),
        F.array_join(text.semantic_tokens(p), ",").alias("semantic"), text.term_fold(p).alias("term"), variants.alias("variants"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate + INTERVAL 10 YEAR, '%Y-%m-%d') || ',2031-03-01' WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate + INTERVAL 10 YEAR, '%Y-%m-%d') ELSE '' END AS mined, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(o_orderdate, '%Y%m%dT%H%M%S') || '000000Z' AS stamp FROM orders""")
def dates_in_text(spark, d):
    """Deadlines mined from sentences (dates of events and far from any word of deadlines are none), and stamps of captures."""
    k = F.col("o_orderkey")
    at = F.date_format(F.col("o_orderdate").cast("date") + F.expr("INTERVAL 10 YEAR"), "d MMMM yyyy")
    said = F.when(k % 3 == 0, F.concat(F.lit("The application deadline is "), at, F.lit(". Semester starts 2031-09-01. Apply by March 1, 2031, please.")))
    said = said.when(k % 3 == 1, F.concat(F.lit("Open day: 2030-05-05. Deadlines: "), at, F.lit(" " + "x" * 100 + " 2029-01-01"))).otherwise(F.concat(F.lit("Founded on "), at))
    stamp = F.col("o_orderdate").cast("timestamp")
    out = parquet(spark, d, "orders").select("o_orderkey", dates.mined_deadlines(said).alias("m"), dates.iso_stamp(stamp).alias("iso"), dates.capture_stamp(stamp).alias("stamp"))
    return out.withColumn("mined", F.array_join(F.transform("m", lambda x: x.cast("string")), ",")).select("o_orderkey", "mined", "iso", "stamp")


@query("SELECT c_custkey, concat_ws(',', 'CV', 'Passport ', CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END) AS merged, c_mktsegment || ',' || 'x' AS parts, 'IELTS=7.0,GRE=' || c_custkey AS tests FROM customer")
def list_functions(spark, d):
    """Ordered unions in any case, lists at semicolons, and test scores."""
    k = F.col("c_custkey")
    right = F.when(k % 2 == 0, F.array(F.lit(" cv "), F.lit("PASSPORT"), F.lit(""), F.col("c_mktsegment"), F.lower("c_mktsegment"))).otherwise(F.array(F.lit("passport")))
    merged = text.merge_unique(F.array(F.lit("CV"), F.lit("Passport ")), right)
    tests = text.parse_tests(F.concat(F.lit("ielts: 7.0 ;none; GRE:"), k.cast("string")))
    return parquet(spark, d, "customer").select(
        "c_custkey", F.array_join(merged, ",").alias("merged"), F.array_join(text.split_list(F.concat("c_mktsegment", F.lit(" ; ;x;"))), ",").alias("parts"), F.array_join(F.transform(tests, lambda t: F.concat(t["name"], F.lit("="), t["score"])), ",").alias("tests"),
    )


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'due' WHEN 1 THEN 'old' ELSE 'none' END AS kind, CASE p_partkey % 3 WHEN 0 THEN 'Round 1|2030-05-31|Non-EU;Application|2030-06-01|EU' ELSE '' END AS due FROM part")
def deadline_lists(spark, d):
    """Lists of deadlines: parsed, past and repeated ones dropped, applicant groups told, by date."""
    one = lambda r, day, g=None: F.struct(F.lit(r).alias("round"), F.lit(day).alias("date"), F.lit(g).cast("string").alias("applicantGroup"))
    due = F.array(one("", "June 1, 2030", "EU"), one("Round 1", "31 May 2030", "non-eu applicants"), one("Round 1", "2030-05-31"), one("x", "no date"))
    old = F.array(one("EU", "2020-01-01"))
    k = F.col("p_partkey")
    given = F.when(k % 3 == 0, F.transform(due, lambda x: F.struct(F.when(x["round"] == "Round 1", "Round 1").otherwise(x["round"]).alias("round"), x["date"].alias("date"), F.when(x["round"] == "Round 1", "Non-EU").otherwise(x["applicantGroup"]).alias("applicantGroup")))).when(k % 3 == 1, old)
    got = dates.deadlines(given, F.lit("2024-01-01").cast("date"))
    said = F.array_join(F.transform(got, lambda x: F.concat_ws("|", x["round"], x["date"].cast("string"), x["applicantGroup"])), ";")
    return parquet(spark, d, "part").select("p_partkey", F.when(k % 3 == 0, "due").when(k % 3 == 1, "old").otherwise("none").alias("kind"), F.coalesce(said, F.lit("")).alias("due"))
