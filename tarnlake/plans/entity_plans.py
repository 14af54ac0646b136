"""Lookups, set reconciliation, entity resolution and graph queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.functions import scores, text
from tarnlake.operators import graph, joins, resolve
from tarnlake.plans.registry import registry
from tarnlake.sources.readers import parquet

QUERIES: dict = {}
ORACLES: dict = {}
query = registry(QUERIES, ORACLES)


@query("""SELECT id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS appearances, min(label) AS label FROM (SELECT c_custkey AS id, 'customer' AS source, c_name AS label FROM customer UNION ALL SELECT s_suppkey, 'supplier', s_name FROM supplier) GROUP BY id""")
def multi_source_union(spark, d):
    c = parquet(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("source"), F.col("c_name").alias("label"))
    s = parquet(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("source"), F.col("s_name").alias("label"))
    return c.unionByName(s).groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count("*").alias("appearances"), F.min("label").alias("label"))


@query("SELECT c_custkey, coalesce(r_name, n_name, '-') AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) r ON n_regionkey = r_regionkey")
def dimension_fallback_join(spark, d):
    n, r = parquet(spark, d, "nation"), parquet(spark, d, "region").where("r_regionkey <> 2")
    c = parquet(spark, d, "customer").select("c_custkey", "c_nationkey")
    out = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("c_custkey", F.coalesce("r_name", "n_name", F.lit("-")).alias("region"))


@query("SELECT p_partkey, coalesce(s.name, c.name, '-') AS name FROM part LEFT JOIN (SELECT s_suppkey AS k, min(s_name) AS name FROM supplier GROUP BY 1) s ON p_partkey = s.k LEFT JOIN (SELECT 'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS k, min(c_mktsegment) AS name FROM customer GROUP BY 1) c ON 'Customer#' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') = c.k")
def prioritized_lookup(spark, d):
    p = parquet(spark, d, "part").select("p_partkey", F.format_string("Customer#%09d", "p_partkey").alias("as_name"))
    by_key = parquet(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    by_name = parquet(spark, d, "customer").select("c_name", F.col("c_mktsegment").alias("name"))
    return joins.lookup(p, [("p_partkey", by_key, "s_suppkey"), ("as_name", by_name, "c_name")], "name", F.lit("-")).select("p_partkey", "name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_missing(spark, d):
    o = parquet(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return parquet(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def anti_gap(spark, d):
    done = parquet(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.remaining(parquet(spark, d, "customer").select("c_custkey"), done, "c_custkey")


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS o, l_partkey AS m FROM lineitem), p AS (SELECT x.o AS a, y.o AS b, count(*) AS shared FROM s x JOIN s y USING (m) WHERE x.o < y.o GROUP BY ALL) SELECT a, b, shared FROM p WHERE shared >= 10""")
def overlap_join(spark, d):
    return joins.overlaps(parquet(spark, d, "lineitem"), "l_suppkey", "l_partkey", 10)


@query("SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS both, (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS left_only, (SELECT count(*) FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders)) AS right_only")
def reconcile_sets(spark, d):
    o = parquet(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return joins.reconcile(o, parquet(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k")


@query("WITH RECURSIVE e AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey > 3 THEN s_suppkey // 2 END AS up FROM supplier), w(id, cur) AS (SELECT id, id FROM e UNION ALL SELECT w.id, e.up FROM w JOIN e ON w.cur = e.id WHERE e.up IS NOT NULL) SELECT id, min(cur) AS root FROM w GROUP BY id")
def alias_flatten(spark, d):
    k = F.col("s_suppkey")
    edges = parquet(spark, d, "supplier").select(k.alias("id"), F.when(k > 3, F.floor(k / 2).cast("long")).alias("next"))
    return graph.flatten_chains(edges)


@query("""WITH RECURSIVE e AS (SELECT page_id AS p, CASE WHEN page_id > 0 THEN page_id // 3 END AS up FROM pages), s AS (SELECT page_id AS s FROM pages WHERE page_id % 7 = 1),
w(page, cur) AS (SELECT p, p FROM e UNION ALL SELECT w.page, e.up FROM w JOIN e ON w.cur = e.p WHERE e.up IS NOT NULL AND w.cur NOT IN (SELECT s FROM s)) SELECT page, cur AS stop FROM w WHERE cur IN (SELECT s FROM s)""")
def parent_climb(spark, d):
    from tarnlake.operators.evidence import climb

    k = F.col("page_id")
    pages = parquet(spark, d, "pages").select("page_id", F.when(k > 0, F.floor(k / 3).cast("long")).alias("parent"))
    return climb(pages, "page_id", "parent", pages.where(k % 7 == 1).select(k.alias("s")), "s")


@query("""WITH RECURSIVE k AS (SELECT doc_id, left(text, 30) AS g FROM documents UNION ALL SELECT doc_id, '>' || right(text, 30) FROM documents), f AS (SELECT g, min(doc_id) AS m FROM k GROUP BY g), e AS (SELECT DISTINCT doc_id AS a, m AS b FROM k JOIN f USING (g) WHERE doc_id <> m), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id WHERE r.c < l.b) SELECT id AS doc_id, min(c) AS component_id FROM r GROUP BY id""")
def connected_components(spark, d):
    docs = parquet(spark, d, "documents").select("doc_id", "text")
    keys = docs.select("doc_id", F.left("text", F.lit(30)).alias("g")).union(docs.select("doc_id", F.concat(F.lit(">"), F.right("text", F.lit(30)))))
    first = keys.groupBy("g").agg(F.min("doc_id").alias("m"))
    edges = keys.join(first, "g").select(F.col("doc_id").alias("a"), F.col("m").alias("b"))
    label = graph.components(edges, "text-ends").withColumnRenamed("id", "doc_id")
    return docs.select("doc_id").join(label, "doc_id", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))


@query()
def constrained_resolution(spark, d):
    s = parquet(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"), "s_acctbal")
    near = s.alias("x").join(s.alias("y"), (F.col("x.nation") == F.col("y.nation")) & (F.col("x.id") < F.col("y.id")))
    gap = F.abs(F.col("x.s_acctbal") - F.col("y.s_acctbal"))
    merges = near.where(gap < 2500).select(F.col("x.nation").alias("nation"), F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.floor(gap).alias("step"))
    apart = near.where(F.col("y.id") - F.col("x.id") == 25).select(F.col("x.nation").alias("nation"), F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    return resolve.constrained_components(s.select("nation", "id"), merges, apart, "nation")


@query()
def fuzzy_pairs(spark, d):
    p = parquet(spark, d, "part").select("p_brand", "p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("name"))
    return resolve.fuzzy_pairs(p, "p_brand", "p_partkey", "name")


@query(r"""WITH t AS (SELECT item_id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 1)) AS x FROM benchmark), u AS (SELECT doc_id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 1)) AS y FROM documents),
p AS (SELECT item_id, doc_id, len(list_intersect(x, y)) AS shared, len(x) + len(y) - len(list_intersect(x, y)) AS every FROM t, u) SELECT item_id, doc_id, shared, every FROM p WHERE shared > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY shared / every DESC, doc_id) = 1""")
def token_jaccard(spark, d):
    """The most similar document of each benchmark item by token sets."""
    toks = lambda name, key: parquet(spark, d, name).select(F.col(key).alias("o"), F.explode(F.array_distinct(F.filter(F.split(text.fold_search(F.col("text")), " "), lambda t: F.length(t) > 1))).alias("m"))
    return joins.most_alike(toks("benchmark", "item_id"), toks("documents", "doc_id")).toDF("item_id", "doc_id", "shared", "every")


@query("SELECT c_nationkey, arg_min(c_mktsegment, (-n, first)) AS c_mktsegment FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY ALL) GROUP BY c_nationkey")
def canonical_choice(spark, d):
    return resolve.canonical(parquet(spark, d, "customer"), "c_nationkey", "c_mktsegment", "c_custkey")


@query("""WITH m AS (SELECT avg(epoch_us(ts)) AS mid FROM events), o AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds, max(event_id) AS last FROM events, m WHERE epoch_us(ts) <= mid GROUP BY 1), n AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds, max(event_id) AS last FROM events, m WHERE epoch_us(ts) > mid GROUP BY 1)
SELECT coalesce(n.user_id, o.user_id) AS user_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(o.kinds, []), coalesce(n.kinds, [])))), ',') AS kinds, coalesce(n.last, o.last) AS last FROM o FULL JOIN n ON o.user_id = n.user_id""")
def status_upsert(spark, d):
    """What the earlier half of the time left of each user, and what the later one brings: all events on one side or the other."""
    e = parquet(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    mid = e.agg(F.avg("us")).first()[0]
    one = lambda df: df.groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"), F.max("event_id").alias("last"))
    out = joins.upsert(one(e.where(F.col("us") <= mid)), one(e.where(F.col("us") > mid)), "user_id", ["kinds"], ["last"])
    return out.withColumn("kinds", F.array_join("kinds", ","))


@query("SELECT a.l_returnflag AS l_returnflag, count(*) AS n FROM lineitem a WHERE a.l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1")
def semi_join_counts(spark, d):
    o = parquet(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return parquet(spark, d, "lineitem").select("l_orderkey", "l_returnflag").join(o, "l_orderkey", "left_semi").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query()
def digests(spark, d):
    return parquet(spark, d, "customer").select("c_custkey", scores.digest(F.col("c_name"), F.col("c_mktsegment")).alias("digest"))


ORACLES["digests"] = r"SELECT c_custkey, sha256(c_name || chr(0) || c_mktsegment)[1:16] AS digest FROM customer"
