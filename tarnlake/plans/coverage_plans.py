"""Coverage, audits, merges and graph steps over the test tables: orders stand for programmes, customers for institutions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.functions import rules, scores, text, urls
from tarnlake.operators import audit, coverage, dedup, evidence, joins, ladders, merge, resolve
from tarnlake.plans.registry import pick, pick_sql, registry
from tarnlake.sources.readers import parquet

QUERIES: dict = {}
ORACLES: dict = {}
query = registry(QUERIES, ORACLES)

_FLAGS = {"requirements": "o_orderkey % 2 = 0", "deadline": "o_orderkey % 3 = 0", "documents": "o_orderstatus = 'F'", "language": "o_totalprice > 250000"}
_CATEGORIES = list(_FLAGS)


def _programs(spark, d):
    return parquet(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("program"), *(F.expr(e).alias(c) for c, e in _FLAGS.items()))


def _shared(spark, d):
    """What pages of an institution prove, several rows each."""
    k = F.col("c_custkey")
    rows = parquet(spark, d, "customer").select(k.alias("entity"), *((k % (5 + i) == 0).alias(c) for i, c in enumerate(_CATEGORIES)))
    return rows.union(rows.select("entity", *(F.lit(False) for _ in _CATEGORIES)))


_MODES = (
    "WITH p AS (SELECT o_custkey AS entity, " + ", ".join(f"{e} AS {c}" for c, e in _FLAGS.items()) + ", " + ", ".join(f"o_custkey % {5 + i} = 0 AS s_{c}" for i, c in enumerate(_CATEGORIES)) + " FROM orders), x AS ("
    + " UNION ALL ".join(f"SELECT entity, 'direct' AS mode, '{c}' AS category, {c} AS has FROM p UNION ALL SELECT entity, 'includingShared', '{c}', {c} OR s_{c} FROM p" for c in _CATEGORIES)
    + " UNION ALL SELECT entity, 'direct', 'essentialBundle', requirements AND deadline AND documents FROM p UNION ALL SELECT entity, 'includingShared', 'essentialBundle', (requirements OR s_requirements) AND (deadline OR s_deadline) AND (documents OR s_documents) FROM p),"
    " e AS (SELECT entity, mode, category, count(*) AS programs, count(*) FILTER (has) AS covered, round_even(count(*) FILTER (has) / count(*), 4) AS rate, bool_or(has) AS any, bool_and(has) AS full FROM x GROUP BY ALL)"
)


def _by_mode(spark, d):
    programs = coverage.shared_by_entity(_programs(spark, d), "entity", _shared(spark, d), _CATEGORIES)
    return coverage.by_mode(programs, "entity", _CATEGORIES, list(coverage.ESSENTIAL))


@query(_MODES + " SELECT * FROM e")
def coverage_by_mode(spark, d):
    """Coverage of each institution's programmes, direct and with what its pages prove for all of them, and the bundle of essentials."""
    return _by_mode(spark, d)


@query(_MODES + ", s AS (SELECT c_custkey AS entity, c_mktsegment AS source FROM customer UNION SELECT c_custkey, 'ALL' FROM customer WHERE c_acctbal > 0) SELECT source, mode, category, sum(programs)::BIGINT AS programs, sum(covered)::BIGINT AS covered, count(*) FILTER (e.any) AS any, count(*) FILTER (e.full) AS full FROM e JOIN s USING (entity) GROUP BY ALL")
def coverage_by_board(spark, d):
    """The same by board; an institution counts once on each board it is on."""
    c = parquet(spark, d, "customer")
    on = c.select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("source")).union(c.where("c_acctbal > 0").select("c_custkey", F.lit("ALL")))
    return coverage.by_source(_by_mode(spark, d), "entity", on)


@query("""WITH e AS (SELECT o_custkey AS entity, count(*) AS n, count(*) FILTER (o_orderkey % 2 = 0) / count(*) AS r1, count(*) FILTER (o_orderkey % 3 = 0) / count(*) AS r2, count(*) FILTER (o_orderstatus = 'F') / count(*) AS r3 FROM orders GROUP BY 1) SELECT entity, n, round((r1 + r2 + r3) / 5, 9) AS mean_rate, row_number() OVER (ORDER BY entity % 4 <> 0, n DESC, round((r1 + r2 + r3) / 5, 9), entity) - 1 AS place FROM e""")
def gap_priorities(spark, d):
    """Institutions in order of what is worth filling: boards first, many programmes, low mean coverage (rates not known count 0)."""
    share = lambda c: F.count_if(c) / F.count("*")
    k = F.col("o_orderkey")
    e = parquet(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.count("*").alias("n"), share(k % 2 == 0).alias("r1"), share(k % 3 == 0).alias("r2"), share(F.col("o_orderstatus") == "F").alias("r3"), F.lit(None).cast("double").alias("r4"), F.lit(0.0).alias("r5"))
    rows = coverage.priority(e, "entity", ["r1", "r2", "r3", "r4", "r5"]).withColumns({"mean_rate": F.round("mean_rate", 9), "off": (F.col("entity") % 4 != 0).cast("int"), "down": -F.col("n")})
    return dedup.global_position(rows, ["off", "down", "mean_rate", "entity"], "place").select("entity", "n", "mean_rate", "place")


@query("SELECT o_custkey AS entity, o_orderkey AS program, concat_ws(',', CASE WHEN o_orderkey % 2 <> 0 THEN 'requirements' END, CASE WHEN o_orderkey % 3 <> 0 THEN 'deadline' END, CASE WHEN o_orderstatus <> 'F' THEN 'documents' END, CASE WHEN NOT o_totalprice > 250000 THEN 'language' END) AS missing FROM orders WHERE NOT (o_orderkey % 6 = 0 AND o_orderstatus = 'F' AND o_totalprice > 250000)")
def programme_gaps(spark, d):
    found = coverage.gaps(_programs(spark, d), "entity", _CATEGORIES, [F.col("entity"), F.col("program")])
    return found.select("entity", "program", F.array_join("missing", ",").alias("missing"))


@query("""SELECT l_partkey, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS suppliers, array_to_string(list_sort(list(DISTINCT l_shipdate::DATE::VARCHAR)), ',') AS days, max(l_quantity) AS score, coalesce(array_to_string(list_sort(list(DISTINCT l_returnflag) FILTER (l_returnflag <> 'N')), ','), '') AS groups, count(*) AS n FROM lineitem GROUP BY l_partkey""")
def merged_observations(spark, d):
    """Observations of one thing united: sets of values, the highest score, the groups that say something."""
    rows = parquet(spark, d, "lineitem").select("l_partkey", "l_suppkey", F.col("l_shipdate").cast("date").cast("string").alias("day"), F.col("l_quantity").alias("score"), F.when(F.col("l_returnflag") == "N", "none").otherwise(F.col("l_returnflag")).alias("g"))
    out = coverage.merged_observations(rows, ["l_partkey"], ["l_suppkey", "day"], "score", "g")
    return out.select("l_partkey", F.array_join(F.transform("l_suppkey", lambda x: x.cast("string")), ",").alias("suppliers"), F.array_join("day", ",").alias("days"), "score", F.array_join("groups", ",").alias("groups"), "n")


_PAGE_STATUS = ("captured", "blocked", "pending", "error", "odd")
_PREC = "CASE status WHEN 'captured' THEN 5 WHEN 'blocked' THEN 4 WHEN 'error' THEN 3 WHEN 'pending' THEN 2 WHEN 'missing' THEN 1 ELSE 0 END"


@query(f"""WITH p AS (SELECT l_returnflag AS scope, l_suppkey AS entity, l_partkey AS program, {pick_sql(_PAGE_STATUS, "l_linenumber")} AS status, l_quantity > 25 AS requirements, l_discount > 0.05 AS deadline FROM lineitem), b AS (SELECT scope, entity, program, max({_PREC}) AS best, bool_or(requirements) AS requirements, bool_or(deadline) AS deadline FROM p GROUP BY ALL)
SELECT scope, count(*) AS programs, count(*) FILTER (best = 5) AS captured, count(*) FILTER (requirements) AS requirements, count(*) FILTER (deadline) AS deadline, count(*) FILTER (requirements AND deadline) AS complete FROM b GROUP BY scope""")
def scope_summary(spark, d):
    """Per scope the programmes of both corpora, each with its best status and all that any page proves (the union over corpora)."""
    rows = parquet(spark, d, "lineitem").select(F.col("l_returnflag").alias("scope"), F.col("l_suppkey").alias("entity"), F.col("l_partkey").alias("program"), pick(_PAGE_STATUS, "l_linenumber").alias("status"), (F.col("l_quantity") > 25).alias("requirements"), (F.col("l_discount") > 0.05).alias("deadline"))
    return coverage.scope_summary(rows, "scope", "status", rules.PAGE_STATUSES, ["requirements", "deadline"])


@query("SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS urls, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1")
def corpora_union(spark, d):
    """What several corpora have of each institution, once each, with exact distinct counts."""
    rows = parquet(spark, d, "lineitem")
    both = rows.where("l_returnflag = 'A'").select("l_suppkey", "l_partkey").union(rows.where("l_returnflag = 'R'").select("l_suppkey", "l_partkey"))
    got = both.groupBy("l_suppkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("u"), F.count_distinct("l_partkey").alias("n"))
    return got.select("l_suppkey", F.array_join(F.transform("u", lambda x: x.cast("string")), ",").alias("urls"), "n")


@query("SELECT o_custkey, string_agg(o_orderpriority || ':' || o_orderkey % 50 || ':' || o_orderkey, ',' ORDER BY list_position(['5-LOW', '1-URGENT', '3-MEDIUM', '2-HIGH', '4-NOT SPECIFIED'], o_orderpriority), o_orderkey % 50, o_orderkey) AS appearances, sum(length(o_orderpriority))::BIGINT AS letters FROM orders GROUP BY 1")
def ordered_appearances(spark, d):
    """Appearances of each institution as an ordered list: by board in the boards' own order, rank and id; lengths added up."""
    boards = F.array(*map(F.lit, ("5-LOW", "1-URGENT", "3-MEDIUM", "2-HIGH", "4-NOT SPECIFIED")))
    item = F.struct(F.array_position(boards, F.col("o_orderpriority")).alias("at"), (F.col("o_orderkey") % 50).alias("rank"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source"))
    got = parquet(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(item)).alias("a"), F.sum(F.length("o_orderpriority")).alias("letters"))
    return got.select("o_custkey", F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["source"], x["rank"].cast("string"), x["id"].cast("string"))), ",").alias("appearances"), "letters")


@query("WITH m AS (SELECT o_orderstatus AS status, count(*) AS rows FROM orders GROUP BY 1), s AS (SELECT 'F' AS status, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS said UNION ALL SELECT 'O', 1 UNION ALL SELECT 'Z', 3) SELECT coalesce(m.status, s.status) AS status, coalesce(rows, 0) AS rows, coalesce(said, 0)::BIGINT AS said, coalesce(rows, 0) = coalesce(said, 0) AND coalesce(m.status, s.status) IN ('F', 'O') AS ok FROM m FULL JOIN s ON m.status = s.status")
def audit_status_sums(spark, d):
    o = parquet(spark, d, "orders")
    said = o.where("o_orderstatus = 'F'").groupBy(F.lit("F").alias("status")).agg(F.count("*").alias("n")).union(spark.createDataFrame([("O", 1), ("Z", 3)], "status string, n long"))
    return audit.status_sums(o, "o_orderstatus", ["F", "O"], said)


_AUDITED = ("https://e.org/a", "http://dauphine.psl.eu/x", "ftp://e.org/b", "https://www.mastersportal.com/1", "https://e.org/c", "", "https://e.org/d")


@query(f"""WITH u AS (SELECT p_type AS kind, p_size % 3 AS owner, {pick_sql(_AUDITED, "p_partkey")} || CASE WHEN p_partkey % 2 = 0 AND p_partkey % 7 NOT IN (1, 5) THEN CAST(p_partkey AS VARCHAR) ELSE '' END AS url FROM part), e AS (SELECT kind, url, count(*) AS n, min(owner) <> max(owner) AS several, regexp_extract(url, '^[a-z]+://([^/]*)', 1) = 'dauphine.psl.eu' AS may FROM u WHERE url <> '' GROUP BY ALL)
SELECT kind, urls, not_http, aggregator, repeated, collisions, shared FROM (SELECT kind, count(*) AS urls, count(*) FILTER (NOT starts_with(url, 'http')) AS not_http, count(*) FILTER (regexp_matches(url, 'mastersportal|studyportals|findamasters|topuniversities|wikipedia')) AS aggregator FROM u GROUP BY kind)
JOIN (SELECT kind, count(*) FILTER (n > 1) AS repeated, count(*) FILTER (several AND NOT may) AS collisions, count(*) FILTER (several AND may) AS shared FROM e GROUP BY kind) USING (kind)""")
def audit_urls(spark, d):
    k = F.col("p_partkey")
    tail = F.when((k % 2 == 0) & ~(k % 7).isin(1, 5), k.cast("string")).otherwise("")
    return audit.url_audit(parquet(spark, d, "part").select(F.col("p_type").alias("kind"), (F.col("p_size") % 3).alias("owner"), F.concat(pick(_AUDITED, "p_partkey"), tail).alias("url")))


_GROUPS = ("EU", "Non-EU", None, "All", "Domestic")
_DAY = "CASE WHEN k % 9 = 0 THEN '2025' WHEN k % 9 = 1 THEN '2025-02-30' ELSE strftime(day, '%Y-%m-%d') END"


@query(f"""WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS day FROM orders), x AS (SELECT {_DAY} AS date, coalesce({pick_sql(_GROUPS, "k")}, 'Unknown') AS g FROM o UNION ALL SELECT strftime(day, '%Y-%m-%d'), 'Unknown' FROM o WHERE k % 2 = 0), y AS (SELECT *, TRY_CAST(CASE WHEN length(date) = 10 THEN date END AS DATE) AS t FROM x)
SELECT count(*) AS entries, count(*) FILTER (t IS NULL) AS not_iso, count(*) FILTER (t < DATE '1998-06-01') AS past, count(*) FILTER (t IS NOT NULL AND g = 'Domestic') AS bad_group, count(*) FILTER (t IS NOT NULL AND g = 'EU') AS group_eu, count(*) FILTER (t IS NOT NULL AND g = 'Non-EU') AS group_non_eu, count(*) FILTER (t IS NOT NULL AND g = 'All') AS group_all, count(*) FILTER (t IS NOT NULL AND g = 'Unknown') AS group_unknown FROM y""")
def audit_deadlines(spark, d):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    item = lambda v, g: F.array(F.struct(v.alias("date"), g.cast("string").alias("applicantGroup")))
    said = F.when(k % 9 == 0, "2025").when(k % 9 == 1, "2025-02-30").otherwise(day)
    rows = parquet(spark, d, "orders").select(item(said, pick(_GROUPS, "o_orderkey")).alias("deadlines"), F.when(k % 2 == 0, item(day, F.lit(None))).alias("windows"))
    return audit.deadline_audit(rows, ["deadlines", "windows"], F.lit("1998-06-01").cast("date"))


@query("WITH o AS (SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(DISTINCT o_custkey) AS c FROM orders) SELECT 'verified' AS measure, f AS computed, f AS said, true AS ok FROM o UNION ALL SELECT 'total', n, n + 1, false FROM o UNION ALL SELECT 'institutions', c, NULL, false FROM o")
def audit_consistency(spark, d):
    o = parquet(spark, d, "orders")
    measures = {"verified": F.count_if(F.col("o_orderstatus") == "F"), "total": F.count("*"), "institutions": F.count_distinct("o_custkey")}
    said = o.agg(F.count_if(F.col("o_orderstatus") == "F").alias("verified"), (F.count("*") + 1).alias("total"), F.lit(None).cast("long").alias("institutions"))
    return audit.consistency(o, measures, said)


@query("WITH f AS (SELECT 'f' || doc_id AS path, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 5 <> 0), r AS (SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN sha256('x') WHEN doc_id % 3 = 1 THEN sha256(coalesce(text, '')) END AS h FROM documents WHERE doc_id % 7 <> 0) SELECT CASE WHEN f.path IS NULL THEN 'missing' WHEN r.path IS NULL THEN 'unreferenced' WHEN r.h IS NULL OR r.h = f.h THEN 'verified' ELSE 'mismatched' END AS state, count(*) AS n FROM f FULL JOIN r ON f.path = r.path GROUP BY 1")
def audit_inventory(spark, d):
    """Files against what refers to them, by digest."""
    k, path = F.col("doc_id"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path")
    docs = parquet(spark, d, "documents")
    h = F.sha2(F.coalesce("text", F.lit("")), 256)
    return audit.inventory(docs.where(k % 5 != 0).select(path, h.alias("sha256")), docs.where(k % 7 != 0).select(path, F.when(k % 3 == 0, F.sha2(F.lit("x"), 256)).when(k % 3 == 1, h).alias("sha256")))


@query("""WITH t AS (SELECT event_id, 'C' || user_id % 4 AS country, event_type AS kind, CASE WHEN value > 50 THEN 'done' ELSE 'open' END AS status, CASE WHEN event_id % 3 <> 0 THEN event_id % 500 END AS m, CASE WHEN event_id % 5 <> 0 THEN event_id % 4 END AS h FROM events), s AS (SELECT DISTINCT event_id AS m, CASE WHEN event_id % 2 = 0 THEN event_id % 4 END AS said FROM events WHERE event_id < 400)
SELECT country, kind, status, count(*) AS tasks, count(s.m) AS with_manifest, count(*) FILTER (t.m IS NOT NULL AND s.m IS NULL) AS missing_manifest, count(*) FILTER (s.m IS NOT NULL AND said IS NOT NULL AND h IS NOT NULL) AS hash_checked, count(*) FILTER (said = h) AS hash_matched FROM t LEFT JOIN s ON t.m = s.m GROUP BY ALL""")
def audit_queue(spark, d):
    k = F.col("event_id")
    e = parquet(spark, d, "events")
    tasks = e.select(F.concat(F.lit("C"), (F.col("user_id") % 4).cast("string")).alias("country"), F.col("event_type").alias("kind"), F.when(F.col("value") > 50, "done").otherwise("open").alias("status"), F.when(k % 3 != 0, k % 500).alias("manifest"), F.when(k % 5 != 0, k % 4).alias("sha256"))
    return audit.queue_audit(tasks, e.where(k < 400).select(k.alias("manifest"), F.when(k % 2 == 0, k % 4).alias("sha256")).distinct())


@query("SELECT o_orderpriority AS source, count(*) AS rows, count(DISTINCT o_custkey) AS ids, count(*) = 3000 AS ok FROM orders GROUP BY 1")
def audit_scope(spark, d):
    return audit.scope_check(parquet(spark, d, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("id")), 3000)


@query("""WITH p AS (SELECT o_custkey AS k, CASE WHEN o_orderpriority = '1-URGENT' THEN 'program' WHEN o_orderpriority = '2-HIGH' THEN 'evidence' ELSE 'other' END AS kind, CASE o_orderstatus WHEN 'F' THEN 'captured' WHEN 'O' THEN 'blocked' ELSE 'error' END AS status, o_orderkey % 4 = 0 AS c FROM orders WHERE o_custkey % 9 <> 0)
SELECT c_custkey, coalesce(candidates, 0) AS candidates, coalesce(a, 0) AS program_captured, coalesce(b, 0) AS evidence_blocked, coalesce(e, 0) AS other_captured, CASE WHEN k IS NULL THEN 'missing' ELSE 'found' END AS manifest, coalesce(strict, false) AS strict, coalesce(closed, false) AS closed FROM customer LEFT JOIN (SELECT k, count(*) FILTER (c) AS candidates, count(*) FILTER (kind = 'program' AND status = 'captured') AS a, count(*) FILTER (kind = 'evidence' AND status = 'blocked') AS b, count(*) FILTER (kind = 'other' AND status = 'captured') AS e, bool_and(status = 'captured') AS strict, count(*) FILTER (status = 'error') = 0 AS closed FROM p GROUP BY k) ON k = c_custkey""")
def audit_manifests(spark, d):
    """Every target with its manifest's counts by kind and status, and whether its pages are all captured, or at least closed."""
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "program").when(F.col("o_orderpriority") == "2-HIGH", "evidence").otherwise("page")
    pages = parquet(spark, d, "orders").where("o_custkey % 9 <> 0").select("o_custkey", kind.alias("kind"), text.mapped(F.col("o_orderstatus"), {"F": "captured", "O": "blocked", "P": "error"}).alias("status"), (F.col("o_orderkey") % 4 == 0).alias("candidate"))
    out = audit.manifest_coverage(parquet(spark, d, "customer").select("c_custkey"), pages.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", ["program", "evidence"], ["captured", "blocked", "error"])
    whole = audit.pages_complete(pages.withColumn("outcome", F.when(F.col("status") == "error", "retryableError").otherwise(F.col("status"))), "o_custkey")
    return out.join(whole, F.col("c_custkey") == F.col("o_custkey"), "left").na.fill(False, ["strict", "closed"]).select("c_custkey", "candidates", "program_captured", "evidence_blocked", "other_captured", "manifest", "strict", "closed")


@query("SELECT 'left' AS side, CAST(c_custkey AS VARCHAR) AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT DISTINCT 'right', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def set_differences(spark, d):
    return merge.set_differences(parquet(spark, d, "customer").select(F.col("c_custkey").alias("k")), parquet(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("""WITH s AS (SELECT 'p' || o_orderkey % 400 AS id, o_custkey % 40 AS uid, o_orderkey % 11 AS name, o_orderkey FROM orders), seed AS (SELECT * FROM s WHERE o_orderkey < 100), c AS (SELECT * FROM s WHERE o_orderkey >= 100 AND id NOT IN (SELECT id FROM seed) AND (uid, name) NOT IN (SELECT (uid, name) FROM seed)),
a AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY o_orderkey) = 1), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY uid, name ORDER BY o_orderkey) = 1) SELECT * FROM seed UNION ALL SELECT * FROM b""")
def seeded_union(spark, d):
    """All of the seed, then what a crawl adds: first seen by id and by institution and name."""
    k = F.col("o_orderkey")
    rows = parquet(spark, d, "orders").select(F.concat(F.lit("p"), (k % 400).cast("string")).alias("id"), (F.col("o_custkey") % 40).alias("uid"), (k % 11).alias("name"), "o_orderkey")
    return merge.seeded(rows.where("o_orderkey < 100"), rows.where("o_orderkey >= 100"), "id", ["uid", "name"], [F.col("o_orderkey")])


@query("""WITH b AS (SELECT c_custkey AS id, c_custkey AS uid, c_acctbal > 5000 AS verified, c_custkey % 3 AS n, 'old' AS title FROM customer WHERE c_custkey % 4 <> 0), p AS (SELECT o_custkey AS uid, o_orderkey % 5 AS n, 'new' || o_orderkey AS title, o_orderkey % 7 = 0 AS reviewed FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1),
j AS (SELECT b.id, coalesce(b.uid, p.uid) AS uid, coalesce(verified, false) AS verified, CASE WHEN b.uid IS NULL THEN 'added' WHEN p.uid IS NOT NULL AND NOT verified AND (reviewed OR p.n > b.n) THEN 'replaced' ELSE 'kept' END AS action, b.title AS t1, p.title AS t2, b.n AS n1, p.n AS n2 FROM b FULL JOIN p ON b.uid = p.uid) SELECT id, uid, verified, CASE WHEN action = 'kept' THEN n1 ELSE n2 END AS n, CASE WHEN action = 'kept' THEN t1 ELSE t2 END AS title, action FROM j""")
def merged_pools(spark, d):
    """A store with a pool merged in: verified rows stay, reviewed ones and ones with more deadlines replace, new ones are added."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    base = parquet(spark, d, "customer").where(k % 4 != 0).select(k.alias("id"), k.alias("uid"), (F.col("c_acctbal") > 5000).alias("verified"), (k % 3).alias("n"), F.lit("old").alias("title"))
    pool = parquet(spark, d, "orders").select(F.col("o_custkey").alias("uid"), (o % 5).alias("n"), F.concat(F.lit("new"), o.cast("string")).alias("title"), (o % 7 == 0).alias("reviewed"), "o_orderkey")
    return merge.merge_pools(base, pool, ["uid"], [F.col("o_orderkey")], F.col("n"), F.col("n")).select("id", "uid", "verified", "n", "title", "action")


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'static' WHEN o_orderstatus = 'O' THEN 'browser' ELSE 'review' END AS part, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1")
def exhaustive_partition(spark, d):
    s = F.col("o_orderstatus")
    parts = merge.partition_by(parquet(spark, d, "orders"), {"static": s == "F", "browser": s == "O", "review": ~s.isin("F", "O")})
    out = None
    for name, df in parts.items():
        one = df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT o_orderkey, o_custkey FROM orders")
def merged_shards(spark, d):
    """Four shards put together; each expected key in exactly one of them."""
    o = parquet(spark, d, "orders").select("o_orderkey", "o_custkey")
    shards = [o.where(scores.shard(F.col("o_orderkey").cast("string"), 4) == i) for i in range(4)]
    return merge.merge_shards(shards, o.select("o_orderkey"), "o_orderkey")


@query("""WITH e AS (SELECT user_id, event_id, event_type, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events), f AS (SELECT user_id, event_type, min(event_id) AS first FROM e WHERE event_id % 2 = 0 GROUP BY ALL), l AS (SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS materials FROM f GROUP BY user_id),
s AS (SELECT user_id, count(*) FILTER (event_id % 2 = 0) AS sources, arg_min(v, event_id) FILTER (v IS NOT NULL) AS ielts FROM e GROUP BY user_id) SELECT user_id, coalesce(materials, '') AS materials, sources, ielts FROM s LEFT JOIN l USING (user_id)""")
def merged_fields(spark, d):
    """What the pages of one programme say, field by field: lists united in order of the pages, the first value of each scalar, and where they came from."""
    k = F.col("event_id")
    pages = parquet(spark, d, "events").select("user_id", "event_id", F.concat(F.lit("https://e.org/"), k.cast("string")).alias("url"), F.when(k % 2 == 0, F.array("event_type")).alias("materials"), F.when(k % 3 == 0, F.col("value")).alias("ielts"))
    out = merge.merge_fields(pages, "user_id", "event_id", {"materials": F.lower}, ["ielts"], "url")
    return out.select("user_id", F.array_join("materials", ",").alias("materials"), F.size("materials_sources").cast("long").alias("sources"), "ielts")


@query("""WITH f AS (SELECT c_custkey AS id, 0 AS f, 'a' || c_nationkey AS v FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 1, 'b' || c_nationkey FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 2, 'c' FROM customer WHERE c_custkey % 5 = 0) SELECT id, arg_max(v, f) AS v, min(f)::INT AS first_file FROM f GROUP BY id""")
def last_writer(spark, d):
    """One row per id of several files, the last file's; with the file in which it was first seen."""
    c, k = parquet(spark, d, "customer"), F.col("c_custkey")
    file = lambda m, v: c.where(k % m == 0).select(k.alias("id"), v.alias("v"))
    n = F.col("c_nationkey").cast("string")
    return merge.last_writer([file(2, F.concat(F.lit("a"), n)), file(3, F.concat(F.lit("b"), n)), file(5, F.lit("c"))], "id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'high-' || c_custkey // 20 END AS proposal_group, CASE WHEN c_custkey % 5 = 0 THEN 'false' END AS binding FROM customer")
def attached_proposals(spark, d):
    c = parquet(spark, d, "customer")
    groups = c.where("c_custkey % 5 = 0").groupBy(F.concat(F.lit("high-"), F.floor(F.col("c_custkey") / 20).cast("string")).alias("group")).agg(F.collect_list("c_custkey").alias("members"))
    return merge.attach_proposals(c.select("c_custkey"), groups, "c_custkey").withColumn("binding", F.col("binding").cast("string"))


@query("SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_orderkey = 77 AND o_orderstatus = 'X') AS changed FROM (SELECT o_orderkey, CASE WHEN o_orderkey = 77 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders) GROUP BY 1")
def queue_update(spark, d):
    """One row of a queue updated if it is the only one and as expected; then counted again."""
    o = parquet(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    out = merge.update_one(o, "o_orderkey", 77, F.col("o_orderstatus").isin("F", "O", "P"), {"o_orderstatus": F.lit("X")})
    return out.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if((F.col("o_orderkey") == 77) & (F.col("o_orderstatus") == "X")).alias("changed"))


@query("""WITH w AS (SELECT c_custkey AS k FROM customer), a AS (SELECT o_custkey AS k, o_orderkey AS u FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS k, o_orderkey AS u FROM orders WHERE o_orderpriority = '1-URGENT'), c AS (SELECT c_custkey AS k, -1 AS u FROM customer)
SELECT stage, count(*) AS rows, count(DISTINCT k) AS keys FROM (SELECT 'review' AS stage, a.* FROM a WHERE k IN (SELECT k FROM w) UNION ALL SELECT 'captured', b.* FROM b WHERE k IN (SELECT k FROM w) AND k NOT IN (SELECT k FROM a) UNION ALL SELECT 'audit', c.* FROM c WHERE k NOT IN (SELECT k FROM a) AND k NOT IN (SELECT k FROM b)) GROUP BY stage""")
def sequential_fill(spark, d):
    """Stages that each serve what no stage before did."""
    o = parquet(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("u"), "o_orderstatus", "o_orderpriority")
    c = parquet(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    stages = [("review", o.where("o_orderstatus = 'F'").select("k", "u")), ("captured", o.where("o_orderpriority = '1-URGENT'").select("k", "u")), ("audit", c.withColumn("u", F.lit(-1).cast("long")))]
    return merge.sequential_fill(c, "k", stages).groupBy("stage").agg(F.count("*").alias("rows"), F.count_distinct("k").alias("keys"))


@query("""WITH RECURSIVE l AS (SELECT DISTINCT p_size % 5 AS g, p_partkey AS src, (p_partkey * 3 + p_size) % (SELECT count(*) FROM part) AS dst FROM part UNION SELECT DISTINCT p_size % 5, p_partkey, (p_partkey * 7) % (SELECT count(*) FROM part) FROM part), f(g, page, depth) AS (SELECT r, r * 10, 0 FROM range(0, 5) AS t(r) UNION SELECT f.g, l.dst, f.depth + 1 FROM f JOIN l ON l.g = f.g AND l.src = f.page WHERE f.depth < 4)
SELECT g AS "group", page, min(depth)::INT AS depth FROM f GROUP BY ALL""")
def crawl_frontier(spark, d):
    """Pages reached over a table of links, breadth first within a depth."""
    p = parquet(spark, d, "part")
    n, k = F.lit(p.count()), F.col("p_partkey")
    g = (F.col("p_size") % 5).cast("long").alias("group")
    links = p.select(g, k.alias("src"), ((k * 3 + F.col("p_size")) % n).alias("dst")).union(p.select(g, k, (k * 7) % n))
    seeds = spark.range(5).select(F.col("id").alias("group"), (F.col("id") * 10).alias("page"))
    return merge.frontier(links, seeds, depth=4, pages=1 << 30)


@query("""WITH m AS (SELECT c_nationkey AS e, c_mktsegment || c_custkey % 3 AS m, c_custkey AS t FROM customer), a AS (SELECT e, m, count(*) AS n, min(t) AS first FROM m GROUP BY ALL) SELECT e AS nation, arg_min(m, (m NOT IN ('BUILDING1', 'MACHINERY2') OR e % 3 <> 0, m <> 'FURNITURE0' OR e % 2 <> 0, m <> 'HOUSEHOLD1', -n, first, m)) AS canonical FROM a GROUP BY e""")
def canonical_ids(spark, d):
    """The id an institution goes by: an override, an alias root, a reviewed group's, the earliest of the most frequent."""
    m = F.concat("c_mktsegment", (F.col("c_custkey") % 3).cast("string"))
    rows = parquet(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), m.alias("m"), F.col("c_custkey").alias("t"))
    part = lambda which: rows.where(which)
    named = lambda names: spark.createDataFrame([(n,) for n in names], "m string")
    one = resolve.canonical_id(part("nation % 6 = 0"), "nation", "m", named(["BUILDING1", "MACHINERY2"]), named(["FURNITURE0"]), named(["HOUSEHOLD1"]), "t")
    two = resolve.canonical_id(part("nation % 3 = 0 AND nation % 2 <> 0"), "nation", "m", named(["BUILDING1", "MACHINERY2"]), named([]), named(["HOUSEHOLD1"]), "t")
    three = resolve.canonical_id(part("nation % 3 <> 0 AND nation % 2 = 0"), "nation", "m", named([]), named(["FURNITURE0"]), named(["HOUSEHOLD1"]), "t")
    four = resolve.canonical_id(part("nation % 3 <> 0 AND nation % 2 <> 0"), "nation", "m", named([]), named([]), named(["HOUSEHOLD1"]), "t")
    return one.union(two).union(three).union(four)


@query("""WITH g AS (SELECT o_custkey AS g, o_custkey % 2 = 0 AS merge, list_sort(list(DISTINCT o_orderkey % 60)) AS m FROM orders WHERE o_custkey < 80 GROUP BY 1), p AS (SELECT merge, a, b FROM (SELECT merge, m, unnest(m) AS a FROM g), LATERAL (SELECT unnest(m) AS b) WHERE a < b) SELECT a, b FROM p GROUP BY a, b HAVING bool_or(merge) AND bool_or(NOT merge)""")
def relationship_conflicts(spark, d):
    """Pairs that reviewers both merge and keep apart."""
    groups = parquet(spark, d, "orders").where("o_custkey < 80").groupBy("o_custkey").agg(F.collect_set(F.col("o_orderkey") % 60).alias("members"))
    return resolve.relationship_conflicts(groups.select("members", (F.col("o_custkey") % 2 == 0).alias("merge")))


@query("""WITH e AS (SELECT c_custkey AS id, c_nationkey AS land, c_custkey // 7 AS name FROM customer), t AS (SELECT s_suppkey AS target, s_nationkey AS land, s_suppkey // 2 AS name, s_suppkey * 3 AS member FROM supplier), m AS (SELECT id, target, true AS by_id FROM e JOIN t ON id = member OR id = member + 1 UNION ALL SELECT id, target, false FROM e JOIN t ON e.land = t.land AND e.name = t.name),
u AS (SELECT id, target, bool_or(by_id) AS by_id FROM m GROUP BY ALL) SELECT id, target, by_id, count(*) OVER (PARTITION BY id) > 1 AS ambiguous FROM u""")
def raw_target_matches(spark, d):
    """Institutions and crawl targets that share an id or have the same country and name; several targets are told."""
    e = parquet(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("land"), F.floor(F.col("c_custkey") / 7).alias("name"))
    k = F.col("s_suppkey")
    t = parquet(spark, d, "supplier").select(k.alias("target"), F.col("s_nationkey").alias("land"), F.floor(k / 2).alias("name"), F.array(k * 3, k * 3 + 1).alias("members"))
    return joins.match_targets(e.select("id", F.array("id").alias("ids"), "land", "name"), t, ["land", "name"])


@query(r"""WITH t AS (SELECT p_partkey AS t, p_name AS name, p_size % 4 AS land FROM part), o AS (SELECT DISTINCT p_name || ' ring' AS name, p_size % 4 AS land FROM part UNION SELECT DISTINCT p_name, p_size % 4 FROM part WHERE p_size % 2 = 0), w AS (SELECT t, o.name AS org, t.land = o.land AS same, t.name = o.name AS exact, list_sort(list_distinct(string_split(t.name, ' '))) AS x, list_sort(list_distinct(string_split(o.name, ' '))) AS y FROM t JOIN o ON o.name = t.name OR o.name = t.name || ' ring')
SELECT t, max(round((CASE WHEN exact THEN 0.52 WHEN x = y THEN 0.38 ELSE 0 END) + 0.16 * len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) + (CASE WHEN same THEN 0.08 ELSE -0.35 END) + 0.02, 4)) AS score, bool_or(exact AND same) AS exact FROM w GROUP BY t""")
def registry_matches(spark, d):
    """The best organisation of a registry for each name, by score (the share of sequence similarity is tested apart)."""
    p = parquet(spark, d, "part").withColumn("land", F.col("p_size") % 4)
    orgs = p.select(F.concat("p_name", F.lit(" ring")).alias("org"), "land").union(p.where("p_size % 2 = 0").select("p_name", "land")).distinct()
    keys = orgs.select("org", F.col("land").alias("org_land"), F.regexp_replace("org", " ring$", "").alias("k")).union(orgs.select("org", "land", F.col("org").alias("k"))).distinct()
    both = p.join(keys, F.col("p_name") == F.col("k")).where("org = p_name OR org = concat(p_name, ' ring')")
    x, y = (F.array_sort(F.array_distinct(F.split(c, " "))) for c in ("p_name", "org"))
    exact, same = F.col("p_name") == F.col("org"), F.col("land") == F.col("org_land")
    found = ladders.registry_score(exact, x == y, F.lit(0.0), scores.jaccard(x, y), same, F.lit(True))
    return both.groupBy(F.col("p_partkey").alias("t")).agg(F.max(found["score"]).alias("score"), F.bool_or(exact & same).alias("exact"))


_BLOCKS = (("(?:computer|data) science", 6), (r"\bengineering\b", 5), ("robot", 3))


@query("SELECT p_partkey, s::INT AS score, CASE WHEN s >= 12 THEN 'strong' WHEN s >= 5 THEN 'moderate' WHEN s > 0 THEN 'weak' ELSE 'none' END AS level, CASE WHEN p_partkey % 6 = 0 THEN 'both' WHEN p_partkey % 2 = 0 THEN 'cs' WHEN p_partkey % 3 = 0 THEN 'engineering' ELSE 'none' END AS side FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 6 ELSE 0 END + CASE WHEN p_partkey % 3 = 0 THEN 5 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN 6 ELSE 0 END AS s FROM part)")
def block_signals(spark, d):
    """Signals added up over the visible blocks of a page, their level, and which side the terms speak for."""
    k = F.col("p_partkey")
    blocks = F.array(F.when(k % 2 == 0, "Computer Science").otherwise("Home"), F.when(k % 3 == 0, "School of Engineering").otherwise("About"), F.when(k % 5 == 0, "Robots here").otherwise("x"), F.when(k % 5 == 0, "robots there").otherwise("y"))
    score = evidence.block_scores(blocks, _BLOCKS)
    rows = parquet(spark, d, "part").select("p_partkey", score.alias("score"), F.array_join(blocks, " . ").alias("t"))
    side = evidence.surface_group(F.regexp_replace("t", "[Rr]obots", "pages"))
    return rows.select("p_partkey", "score", evidence.level(F.col("score")).alias("level"), side.alias("side"))


@query("SELECT n_name, count(*) AS n, round_even(100 * count(*) FILTER (c_acctbal > 5000) / count(*), 1) AS per_cent, (floor(count(*) FILTER (c_acctbal > 5000) / count(*) * 100 + 0.5)::INT || '%') AS shown FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def coverage_percent(spark, d):
    """Per cent to one place (halves to even), and as pages show it (halves up)."""
    c = parquet(spark, d, "customer").join(parquet(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 5000).alias("c"))
    return c.select("n_name", "n", scores.percent(F.col("c"), F.col("n")).alias("per_cent"), scores.shown_percent(F.col("c") / F.col("n")).alias("shown"))


@query("SELECT CASE WHEN url IN ('https://a.org/x', 'https://b.org/x') THEN 'same' ELSE 'none' END AS group_name, count(*) AS n FROM (SELECT (['https://a.org/x', 'https://b.org/x', 'ftp://c'])[p_partkey % 3 + 1] AS url FROM part) GROUP BY 1")
def merge_url_forms(spark, d):
    """The form in which crawled urls are merged: entities, fragments and slashes at the end make no difference."""
    forms = ("https://a.org/x/#top", "https://b.org/x//", "ftp://c")
    u = urls.merge_url(pick(forms, "p_partkey"))
    return parquet(spark, d, "part").groupBy(F.when(u.isin("https://a.org/x", "https://b.org/x"), "same").otherwise("none").alias("group_name")).agg(F.count("*").alias("n"))
