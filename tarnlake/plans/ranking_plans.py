"""Ranking, dedup, top-k, batching and date queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.functions import dates, scores
from tarnlake.operators import dedup, ranking
from tarnlake.plans.registry import registry
from tarnlake.sources.readers import parquet

QUERIES: dict = {}
ORACLES: dict = {}
query = registry(QUERIES, ORACLES)


@query("SELECT c_custkey, floor(c_acctbal / 100)::BIGINT AS score, rank() OVER (ORDER BY floor(c_acctbal / 100) DESC) AS rank FROM customer")
def rank_competition(spark, d):
    rows = parquet(spark, d, "customer").select("c_custkey", F.floor(F.col("c_acctbal") / 100).cast("long").alias("score"))
    return ranking.competition_rank(rows, "score")


@query("SELECT c_custkey, row_number() OVER (ORDER BY -floor(c_acctbal / 100), c_custkey) AS rank FROM customer")
def rank_sequential(spark, d):
    rows = parquet(spark, d, "customer").select("c_custkey", (-F.floor(F.col("c_acctbal") / 100)).alias("down"))
    return ranking.sequential_rank(rows, ["down", "c_custkey"]).select("c_custkey", "rank")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = 1")
def keep_best_per_key(spark, d):
    rows = parquet(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return dedup.keep_best(rows, ["o_custkey"], [F.col("o_totalprice"), F.col("o_orderkey")])


@query("SELECT l_partkey, l_orderkey, l_linenumber, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag DESC, l_quantity DESC, l_extendedprice DESC, l_orderkey, l_linenumber) = 1")
def keep_best_by_signal(spark, d):
    rows = parquet(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice")
    order = [F.col("l_returnflag").desc(), F.col("l_quantity").desc(), F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")]
    return dedup.keep_best(rows, ["l_partkey"], order).select("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY coalesce(o_totalprice, 99999) DESC, o_orderkey LIMIT 500")
def top_n_stable(spark, d):
    rows = parquet(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return ranking.first_n(rows, [F.coalesce("o_totalprice", F.lit(99999.0)).desc(), F.col("o_orderkey")], 500)


@query("""SELECT o_orderpriority, count(*) FILTER (n <= 350) AS selected, count(*) FILTER (n > 350) AS deferred, max(o_orderkey) FILTER (n <= 350) AS last_key
FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders) GROUP BY o_orderpriority""")
def positional_scope(spark, d):
    rows = parquet(spark, d, "orders").select("o_orderpriority", "o_orderkey")
    first = dedup.top_k(rows, ["o_orderpriority"], [F.col("o_orderkey")], 350).groupBy("o_orderpriority").agg(F.count("*").alias("selected"), F.max("o_orderkey").alias("last_key"))
    return rows.groupBy("o_orderpriority").count().join(first, "o_orderpriority").select("o_orderpriority", "selected", (F.col("count") - F.col("selected")).alias("deferred"), "last_key")


@query("""SELECT event_id, user_id, r, previous_rank, last_score FROM (SELECT *, lag(r) OVER w AS previous_rank, last_value(score IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_score
FROM (SELECT event_id, user_id, ts, CAST(event_id % 97 AS INT) AS r, CASE WHEN event_type <> 'error' THEN value END AS score FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE r < previous_rank OR score > last_score""")
def monotonic_warnings(spark, d):
    rows = parquet(spark, d, "events").select("event_id", "user_id", "ts", (F.col("event_id") % 97).cast("int").alias("r"), F.when(F.col("event_type") != "error", F.col("value")).alias("score"))
    return ranking.order_breaks(rows, ["user_id"], [F.col("ts"), F.col("event_id")], "r", "score").select("event_id", "user_id", "r", "previous_rank", "last_score")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, d):
    return dedup.latest(parquet(spark, d, "events"), ["user_id"], ["event_id", "event_type"], ["ts", "event_id"])


@query("""WITH q AS (SELECT p_brand, p_partkey, sum(l_quantity)::BIGINT AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY quantity DESC, p_partkey) AS place, count(*) OVER (PARTITION BY p_brand) AS n FROM q)
SELECT p_brand, p_partkey, quantity, CAST(place AS INT) AS place, greatest(0, n - 3) AS omitted FROM r WHERE place <= 3""")
def top_k_per_group(spark, d):
    parts = parquet(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("quantity"))
    rows = parts.join(parquet(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "p_partkey", "quantity")
    best = dedup.top_k(rows, ["p_brand"], [F.col("quantity").desc(), F.col("p_partkey")], 3, "place")
    n = rows.groupBy("p_brand").agg(F.greatest(F.lit(0), F.count("*") - 3).alias("omitted"))
    return best.join(n, "p_brand")


@query("""WITH o AS (SELECT o_custkey AS k, count(*) AS n, sum(floor(o_totalprice)::BIGINT) AS spend FROM orders GROUP BY 1),
b AS (SELECT k, rank FROM (SELECT c_custkey AS k, rank() OVER (ORDER BY floor(c_acctbal) DESC) AS rank FROM customer) WHERE rank <= 500
UNION ALL SELECT k, rank FROM (SELECT k, rank() OVER (ORDER BY n DESC) AS rank FROM o) WHERE rank <= 500 UNION ALL SELECT k, rank FROM (SELECT k, rank() OVER (ORDER BY spend DESC) AS rank FROM o) WHERE rank <= 500)
SELECT k, count(*) AS boards, avg(rank) AS mean_rank FROM b GROUP BY k HAVING count(*) >= 2 ORDER BY mean_rank, k LIMIT 6""")
def featured_mean_rank(spark, d):
    o = parquet(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.sum(F.floor("o_totalprice").cast("long")).alias("spend"))
    c = parquet(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.floor("c_acctbal").alias("balance"))
    boards = [ranking.competition_rank(df.select("k", s), s).where("rank <= 500") for df, s in ((c, "balance"), (o, "n"), (o, "spend"))]
    return ranking.first_n(ranking.mean_rank(boards, "k", 2), [F.col("mean_rank"), F.col("k")], 6)


@query("SELECT user_id, event_type, votes, CAST(place AS INT) AS place FROM (SELECT user_id, event_type, votes, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, seen) AS place FROM (SELECT user_id, event_type, sum(CASE WHEN event_id % 7 = 0 THEN 5 ELSE 1 END)::BIGINT AS votes, min(event_id) AS seen FROM events GROUP BY ALL)) WHERE place <= 3")
def weighted_votes_top3(spark, d):
    votes = parquet(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum(F.when(F.col("event_id") % 7 == 0, 5).otherwise(1)).alias("votes"), F.min("event_id").alias("seen"))
    return dedup.top_k(votes, ["user_id"], [F.col("votes").desc(), F.col("seen")], 3, "place").drop("seen")


@query("SELECT floor(o_totalprice / 1000)::BIGINT AS price, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return parquet(spark, d, "orders").groupBy(F.floor(F.col("o_totalprice") / 1000).cast("long").alias("price")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT c_custkey, (('0x' || sha256(CAST(c_custkey AS VARCHAR))[1:16])::UBIGINT % 16)::INT AS shard FROM customer")
def deterministic_shard(spark, d):
    return parquet(spark, d, "customer").select("c_custkey", scores.shard(F.col("c_custkey").cast("string"), 16).alias("shard"))


@query("SELECT user_id, event_id, ((row_number() OVER w - 1) // 8)::BIGINT AS batch_no, ((row_number() OVER w - 1) % 8)::INT AS batch_pos FROM events WINDOW w AS (PARTITION BY user_id ORDER BY sha256(CAST(event_id AS VARCHAR)))")
def bounded_batches(spark, d):
    rows = parquet(spark, d, "events").select("user_id", "event_id")
    return dedup.batches(rows, ["user_id"], [F.sha2(F.col("event_id").cast("string"), 256)], 8)


@query("SELECT user_id, event_id, row_number() OVER (ORDER BY user_id, event_id) - 1 AS position FROM events")
def queue_positions(spark, d):
    return dedup.global_position(parquet(spark, d, "events").select("user_id", "event_id"), ["user_id", "event_id"])


@query("WITH n AS (SELECT count(*) AS n FROM orders), w AS (SELECT DISTINCT round_even(i * (n - 1) / 63.0, 0)::BIGINT AS position FROM n, range(0, 64) AS r(i)), o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders) SELECT o_orderkey, position FROM o JOIN w USING (position)")
def even_sample(spark, d):
    return dedup.even_sample(parquet(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 64).select("o_orderkey", "position")


@query("SELECT o_custkey || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS id, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)")
def id_suffixes(spark, d):
    rows = parquet(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("id"), "o_orderkey")
    return dedup.disambiguate(rows, "id", [F.col("o_orderkey")])


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate + INTERVAL 10 YEAR AS DATE) AS day FROM orders) SELECT o_orderkey, strftime(day, '%Y-%m-%d') AS date, datediff('day', DATE '2008-06-01', day)::INT AS days,
CASE WHEN day < DATE '2008-06-01' THEN 'bad' WHEN datediff('day', DATE '2008-06-01', day) <= 21 THEN 'soon' ELSE 'ok' END AS tone FROM o """)
def deadline_normalize(spark, d):
    day = F.col("o_orderdate").cast("date") + F.expr("INTERVAL 10 YEAR")  # the parser reads years from 2000
    forms = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "d MMMM yyyy")).otherwise(F.concat(F.date_format(day, "MMM d"), F.lit(", "), F.date_format(day, "yyyy")))
    rows = parquet(spark, d, "orders").select("o_orderkey", forms.alias("said"))
    as_of = F.lit("2008-06-01").cast("date")
    parsed = rows.select("o_orderkey", dates.parse_date(F.col("said")).alias("date"))
    return parsed.withColumn("days", dates.days_until(F.col("date"), as_of)).withColumn("tone", dates.tone(F.col("days"))).withColumn("date", F.col("date").cast("string"))


@query("""SELECT p_partkey, CAST(p_size AS INT) AS lower, CASE p_partkey % 4 WHEN 2 THEN p_size + 50 WHEN 3 THEN NULL ELSE p_size END::INT AS upper, CASE p_partkey % 4 WHEN 2 THEN 'range' WHEN 3 THEN 'openEnded' ELSE 'exact' END AS type FROM part WHERE p_size >= 1""")
def interval_rank_parse(spark, d):
    s = F.col("p_size").cast("string")
    said = F.when(F.col("p_partkey") % 4 == 0, s).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("="), s)).when(F.col("p_partkey") % 4 == 2, F.concat(s, F.lit("–"), (F.col("p_size") + 50).cast("string"))).otherwise(F.concat(s, F.lit("+")))
    return parquet(spark, d, "part").select("p_partkey", scores.rank_range(said).alias("r")).where("r IS NOT NULL").select("p_partkey", "r.lower", "r.upper", "r.type")


@query("""WITH c AS (SELECT o_custkey AS k, count(*)::INT AS n, count(*) FILTER (o_orderstatus = 'F')::INT AS f, count(*) FILTER (o_orderstatus = 'O')::INT AS o, count(*) FILTER (o_totalprice > 250000)::INT AS v, min(o_orderkey)::INT AS best FROM orders GROUP BY 1)
SELECT k, round_even(least(n, 6) / 6 * 35 + f / greatest(n, 1) * 25 + o / greatest(n, 1) * 25 + v / greatest(n, 1) * 15, 0)::INT AS completeness,
(CASE WHEN f > 0 THEN 100 ELSE 30 END + CASE WHEN o > 0 THEN 40 ELSE 0 END + CASE WHEN v > 0 THEN 30 ELSE 0 END + 8 * n + greatest(0, 20 - best // 25))::INT AS priority FROM c""")
def completeness_score(spark, d):
    c = parquet(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").cast("int").alias("n"), F.count_if(F.col("o_orderstatus") == "F").cast("int").alias("f"), F.count_if(F.col("o_orderstatus") == "O").cast("int").alias("o"), F.count_if(F.col("o_totalprice") > 250000).cast("int").alias("v"), F.min("o_orderkey").cast("int").alias("best"))
    n, f, o, v = (F.col(x) for x in "nfov")
    return c.select("k", scores.completeness(n, f, o, v).alias("completeness"), scores.crawl_priority(f > 0, o > 0, v > 0, n, F.col("best")).alias("priority"))
