"""Serving queries: customers stand for institutions, orders for their programmes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnlake.functions import dates, text
from tarnlake.operators import dedup, merge, serving
from tarnlake.plans.registry import pick, pick_sql, quoted, registry
from tarnlake.sources.readers import parquet

QUERIES: dict = {}
ORACLES: dict = {}
query = registry(QUERIES, ORACLES)

_CID = "CASE WHEN {k} % 3 = 2 THEN {k} - 1 ELSE {k} END"
_STATUS = ("captured", "blocked", "pending", "needs-review", "checked-no-program")
_BOARDS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _universities(spark, d):
    c = parquet(spark, d, "customer").join(parquet(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(parquet(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("country"), F.col("r_name").alias("region"))


def _aliases(spark, d):
    k = F.col("c_custkey")
    return parquet(spark, d, "customer").where(k % 3 == 2).select(k.alias("id"), (k - 1).alias("canonical_id"))


def _programs(spark, d):
    k = F.col("o_orderkey")
    return parquet(spark, d, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("university_id"), F.concat(F.lit("The Program ("), k.cast("string"), F.lit(") "), (k % 5).cast("string")).alias("program"), F.col("o_orderpriority").alias("subject"), (F.col("o_orderstatus") == "F").alias("verified"),
        F.slice(F.array(*(F.lit(f"2030-0{i}-01") for i in (1, 2, 3))), F.lit(1), (k % 4).cast("int")).alias("deadlines"), F.when(k % 6 == 0, "7.0").alias("ielts"), F.concat(F.lit("https://e.org/"), (k % 7).cast("string")).alias("source_url"),
    )


_P = "p AS (SELECT o_orderkey AS id, o_custkey AS uid, " + _CID.format(k="o_custkey") + " AS cid, o_orderkey % 5 AS name, o_orderpriority AS subject, o_orderstatus = 'F' AS verified, o_orderkey % 4 AS n, o_orderkey % 6 = 0 AS req, o_orderkey % 7 AS url FROM orders)"
_FAN = _P + ", f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY cid, url, name ORDER BY id) = 1), u AS (SELECT c_custkey AS id, " + _CID.format(k="c_custkey") + " AS cid FROM customer), fan AS (SELECT u.id AS for_id, f.* FROM u JOIN f USING (cid))"


@query(f"WITH {_FAN} SELECT for_id, count(*) AS total, count(*) FILTER (verified) AS verified, sum(n)::BIGINT AS deadlines, count(*) FILTER (req) AS requirements, min(id) AS first FROM fan GROUP BY for_id")
def programmes_of_every_id(spark, d):
    """Programmes under every id of their institution, one of each url and name."""
    fan = serving.programmes_by_university(_programs(spark, d), _universities(spark, d), _aliases(spark, d))
    return serving.programme_stats(fan, "for_id", F.col("ielts").isNotNull()).join(fan.groupBy("for_id").agg(F.min("id").alias("first")), "for_id")


@query(f"""WITH {_FAN}, s AS (SELECT for_id, count(*) AS programmes, count(*) FILTER (req) AS requirements FROM fan GROUP BY for_id), r AS (SELECT c_custkey, c_name, n_name, coalesce(r_name, n_name) AS region, (1 + c_custkey % 200)::INT AS rank, {pick_sql(_STATUS, "c_custkey", 2)} AS st FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT rank, c_name AS name, region, programmes, requirements FROM r JOIN s ON for_id = c_custkey WHERE requirements > 0 AND region = 'EUROPE' AND st = 'captured' AND (contains(n_name, '3') OR contains(c_name, '3')) ORDER BY rank, name LIMIT 20 OFFSET 5""")
def ranking_page(spark, d):
    """One page of a ranking: joined to programmes and coverage, filtered by region, coverage, requirements and text."""
    u = _universities(spark, d)
    fan = serving.programmes_by_university(_programs(spark, d), u, _aliases(spark, d))
    stats = serving.programme_stats(fan, "for_id", F.col("ielts").isNotNull()).select("for_id", F.col("total").alias("programmes"), "requirements")
    k = F.col("id")
    rows = u.join(stats, k == F.col("for_id"), "left").na.fill(0, ["programmes", "requirements"])
    covered = F.when(pick(_STATUS, "id", 2) == "captured", "covered").otherwise("missing")
    rows = rows.withColumns({"rank": (1 + k % 200).cast("int"), "coverage": covered, "urls": F.lit(1), "is_europe": F.col("region") == "EUROPE"})
    return serving.ranking_page(rows, region="EUROPE", text_="3", europe=True, programmes=True, requirements=True, coverage="covered", limit=20, offset=5).select("rank", "name", "region", "programmes", "requirements")


@query(f"""WITH s AS (SELECT c_name AS name, n_name AS country, {pick_sql(_STATUS, "c_custkey", 2)} AS status, c_custkey % 6 = 0 AS mainland FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT name, country, status FROM s WHERE NOT mainland AND contains(lower(name || ' ' || country), '12') ORDER BY list_position([{", ".join(map(quoted, serving.STATUS_ORDER))}], status), name LIMIT 80""")
def data_status(spark, d):
    schools = _universities(spark, d).select("name", "country", pick(_STATUS, "id", 2).alias("status"), (F.col("id") % 6 == 0).alias("mainland"))
    return serving.data_status(schools, text_=" 12 ").select("name", "country", "status")


@query(f"""WITH u AS (SELECT c_custkey AS id, {_CID.format(k="c_custkey")} AS cid, c_custkey // 2 AS k FROM customer), r AS (SELECT c_mktsegment AS source, (1 + c_custkey % 300)::INT AS rank, c_custkey AS rid, c_custkey // 2 AS k FROM customer), e AS (SELECT u.id, cid, source, rank, rid FROM u JOIN r USING (k)),
f AS (SELECT cid, source, arg_min(rank, (id, rid, rank)) AS rank FROM e GROUP BY ALL), l AS (SELECT cid, string_agg(source || '=' || rank, ',' ORDER BY list_position([{", ".join(map(quoted, reversed(_BOARDS)))}], source)) AS ranks FROM f GROUP BY cid) SELECT id, coalesce(ranks, '') AS ranks FROM u LEFT JOIN l USING (cid)""")
def university_index(spark, d):
    """The ranks of every id on each board: entries that share a name share ranks, ids of one institution have one per board."""
    k = F.col("c_custkey")
    named = F.concat(F.lit("University of X"), F.floor(k / 2).cast("string"), F.lit(" (a)"))
    c = parquet(spark, d, "customer")
    u = c.select(k.alias("id"), named.alias("name"))
    r = c.select(F.col("c_mktsegment").alias("source"), (1 + k % 300).cast("int").alias("rank"), k.alias("university_id"), named.alias("name"))
    out = serving.university_index(u, r, _aliases(spark, d), list(reversed(_BOARDS)))
    return out.select("id", F.array_join(F.transform("ranks", lambda x: F.concat(x["source"], F.lit("="), x["rank"].cast("string"))), ",").alias("ranks"))


@query(f"""WITH {_FAN}, a AS (SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey = 7), r AS (SELECT min(1 + c_custkey % 300) FILTER (c_mktsegment = 'BUILDING') AS building, min(1 + c_custkey % 300) FILTER (c_mktsegment = 'MACHINERY') AS machinery FROM customer WHERE {_CID.format(k="c_custkey")} = 7)
SELECT 8::BIGINT AS asked, a.id AS canonical_id, name, building::INT AS building, machinery::INT AS machinery, (SELECT string_agg(id, ',' ORDER BY NOT verified, id) FROM fan WHERE for_id = 8) AS programs, 'a,b,c,d,e,f' AS urls FROM a, r""")
def university_drawer(spark, d):
    """All that is shown of one institution, asked for by an id that stands for another."""
    c = parquet(spark, d, "customer")
    k = F.col("c_custkey")
    ranks = serving.canonical(c.select(k.alias("x"), F.col("c_mktsegment").alias("source"), (1 + k % 300).cast("int").alias("rank")), "x", _aliases(spark, d)).select(F.col("canonical_id").alias("university_id"), "source", "rank")
    programs = _programs(spark, d).withColumn("program", F.concat(F.lit("p"), (F.col("id") % 5).cast("string")))
    cover = c.select(k.alias("id"), F.array(*map(F.lit, "abcdefgh")).alias("urls"))
    out = serving.drawer(8, _universities(spark, d), _aliases(spark, d), ranks, programs, cover, ["BUILDING", "MACHINERY"])
    listed = F.array_sort(F.col("programs"))
    verified = programs.where("verified").select(F.col("id").alias("v"))
    ids = out.select("asked", F.explode(listed).alias("p")).join(verified, F.col("p") == F.col("v"), "left").groupBy("asked").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("v").isNull().alias("a"), "p"))), lambda x: x["p"].cast("string")), ",").alias("programs"))
    return out.drop("programs").join(ids, "asked").select("asked", "canonical_id", "name", F.col("BUILDING").alias("building"), F.col("MACHINERY").alias("machinery"), "programs", F.array_join("urls", ",").alias("urls"))


@query("SELECT o_orderkey AS id, o_custkey AS university_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_name IN ('Customer#000000003', 'Customer#000000004')")
def programmes_of_a_name(spark, d):
    """Programmes by the name of their institution, entries without a name read from their ids."""
    named = _universities(spark, d).where("id <> 4").select(F.concat(F.lit("u_"), "id").alias("id"), F.when(F.col("id") == 3, "The University of Customer 3-4 (X)").otherwise(F.col("name")).alias("name"))
    uid = F.col("university_id")
    programs = _programs(spark, d).select("id", F.when(uid == 4, "u_customer_3_4").otherwise(F.concat(F.lit("u_"), uid)).alias("university_id"))
    found = serving.programmes_named(programs, named, "Customer 3 4")
    number = F.when(F.col("university_id") == "u_customer_3_4", 4).otherwise(F.regexp_extract("university_id", r"\d+", 0).cast("long"))
    return found.select("id", number.cast("long").alias("university_id"))


@query(f"""WITH {_P} SELECT p.id, row_number() OVER (ORDER BY verified DESC, req DESC, n DESC, c_name, p.id)::INT AS place FROM p JOIN customer ON c_custkey = uid JOIN nation ON c_nationkey = n_nationkey WHERE subject = '1-URGENT' AND n > 0 AND contains(lower(c_name || ' ' || n_name || CASE WHEN req THEN ' ielts 7 0' ELSE '' END), 'ielts 7') QUALIFY place <= 80""")
def programme_search(spark, d):
    """Programmes with their institution, found by text over joined fields and requirements, in the order of the page."""
    u = _universities(spark, d).select(F.col("id").alias("u"), "name", "country")
    rows = _programs(spark, d).join(u, F.col("university_id") == F.col("u"), "left")
    req = F.col("ielts").isNotNull()
    said = F.concat_ws(" ", "program", "subject", "name", "country", F.concat(F.lit("IELTS "), "ielts"))
    found = rows.where((F.col("subject") == "1-URGENT") & (F.size("deadlines") > 0) & F.contains(text.fold_search(said), F.lit("ielts 7")))
    order = [F.col("verified").desc(), req.desc(), F.size("deadlines").desc(), F.collate("name", "UNICODE"), F.col("id")]
    assert len(serving.programme_order(req, F.size("deadlines"), F.col("name"), F.col("program"))) == len(order)
    first = found.withColumn("one", F.lit(1))
    return dedup.top_k(first, ["one"], order, 80, "place").select("id", "place")


@query("""WITH l AS (SELECT c_custkey, c_name, c_mktsegment AS status FROM customer WHERE c_custkey % 10 = 0 OR c_acctbal > 9000), o AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) FILTER (CAST(o_orderdate AS DATE) >= DATE '2001-05-01') AS due, count(*) AS programmes, sum(o_orderkey % 3)::BIGINT AS materials, count(*) FILTER (o_orderkey % 5 = 0) AS checked FROM orders GROUP BY 1),
j AS (SELECT status, c_custkey, c_name, datediff('day', DATE '2001-05-01', due)::INT AS days, coalesce(programmes, 0) AS programmes, coalesce(materials, 0) AS materials, coalesce(checked, 0) AS checked FROM l LEFT JOIN o ON o_custkey = c_custkey) SELECT *, row_number() OVER (PARTITION BY status ORDER BY days NULLS LAST, c_name)::INT AS place FROM j""")
def liked_board(spark, d):
    """Liked institutions with their programmes and checklists by status: nearest deadline first, ones without last, by name."""
    as_of = F.lit("2001-05-01").cast("date")
    liked = parquet(spark, d, "customer").where("c_custkey % 10 = 0 OR c_acctbal > 9000").select("c_custkey", "c_name", F.col("c_mktsegment").alias("status"))
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    per = parquet(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.when(day >= as_of, day)).alias("due"), F.count("*").alias("programmes"), F.sum(k % 3).alias("materials"), F.count_if(k % 5 == 0).alias("checked"))
    rows = liked.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").na.fill(0, ["programmes", "materials", "checked"]).withColumn("days", dates.days_until(F.col("due"), as_of))
    return dedup.top_k(rows, ["status"], [F.col("days").asc_nulls_last(), F.col("c_name")], 1 << 30, "place").select("status", "c_custkey", "c_name", "days", "programmes", "materials", "checked", "place")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'url' WHEN o_custkey % 5 = 0 THEN 'uni' ELSE '' END AS deadlines, CASE WHEN o_orderkey % 4 = 0 THEN '8' WHEN o_custkey % 5 = 0 THEN '7' ELSE '6' END AS ielts, CASE WHEN o_custkey % 5 = 0 THEN '3.0' ELSE NULL END AS gpa, 'CV' || CASE WHEN o_custkey % 5 = 0 THEN ',Passport' ELSE '' END || CASE WHEN o_orderkey % 4 = 0 THEN ',Essay' ELSE '' END AS materials FROM orders""")
def curated_overrides(spark, d):
    """What reviewers said of an institution, then of a programme by its url."""
    k = F.col("o_orderkey")
    base = parquet(spark, d, "orders").select(k.alias("id"), F.col("o_custkey").alias("university_id"), F.concat(F.lit("https://E.org/"), k.cast("string"), F.lit("/#x")).alias("source_url"), F.array().cast("array<string>").alias("deadlines"), F.create_map(F.lit("ielts"), F.lit("6")).alias("requirements"), F.array(F.lit("CV")).alias("materials"))
    over = lambda key, what, r, m: [key.alias("key"), F.array(F.lit(what)).alias("deadlines"), F.create_map(*map(F.lit, r)).alias("requirements"), F.array(*map(F.lit, m)).alias("materials")]
    by_u = parquet(spark, d, "customer").where("c_custkey % 5 = 0").select(*over(F.col("c_custkey"), "uni", ("ielts", "7", "gpa", "3.0", "toefl", ""), ("cv", "Passport")))
    by_p = parquet(spark, d, "orders").where(k % 4 == 0).select(*over(F.concat(F.lit("https://e.org/"), k.cast("string")), "url", ("ielts", "8"), ("Essay",)))
    out = serving.apply_overrides(base, by_u, by_p)
    return out.select("id", F.array_join("deadlines", ",").alias("deadlines"), F.col("requirements")["ielts"].alias("ielts"), F.col("requirements")["gpa"].alias("gpa"), F.array_join("materials", ",").alias("materials"))


_ORDERS = {
    "queue": "lower(n_name), -(c_custkey % 4), CASE WHEN c_custkey % 7 = 0 THEN 1000000000 ELSE c_custkey % 100 END, lower(c_name), c_custkey",
    "by_priority": "-(c_custkey % 9), c_name, c_custkey",
    "scope": "CASE c_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, CASE WHEN c_custkey % 5 = 0 THEN 501 ELSE c_custkey % 350 END, n_name, c_custkey",
    "grouped": "c_mktsegment, -floor(c_acctbal / 1000), c_name, c_custkey",
}


@query("SELECT c_custkey, " + ", ".join(f"row_number() OVER (ORDER BY {o}) - 1 AS {n}" for n, o in _ORDERS.items()) + " FROM customer JOIN nation ON c_nationkey = n_nationkey")
def list_orders(spark, d):
    """Places in the orders of queues, priorities, scopes and groups, each over the whole list without a single-task sort."""
    k = F.col("c_custkey")
    c = parquet(spark, d, "customer").join(parquet(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select(
        "c_custkey", "c_name", "n_name", "c_mktsegment", F.lower("n_name").alias("land"), (-(k % 4)).alias("sources"), F.when(k % 7 == 0, 1000000000).otherwise(k % 100).alias("best"), F.lower("c_name").alias("low"), (-(k % 9)).alias("p"),
        (k % 3).alias("class"), F.when(k % 5 == 0, 501).otherwise(k % 350).alias("row"), (-F.floor(F.col("c_acctbal") / 1000)).alias("score"),
    )
    orders = {"queue": ["land", "sources", "best", "low", "c_custkey"], "by_priority": ["p", "c_name", "c_custkey"], "scope": ["class", "row", "n_name", "c_custkey"], "grouped": ["c_mktsegment", "score", "c_name", "c_custkey"]}
    out = rows.select("c_custkey")
    for name, order in orders.items():
        out = out.join(dedup.global_position(rows, order, name).select("c_custkey", name), "c_custkey")
    return out


@query("SELECT o_orderkey FROM orders QUALIFY (row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1) % 4 = 3 ORDER BY o_custkey, o_orderkey LIMIT 500 OFFSET 100")
def worker_share(spark, d):
    """What one of four workers does: every fourth row in order, from an offset on, up to a limit."""
    return merge.worker_share(parquet(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], 4, 3, 100, 500).select("o_orderkey")


@query("SELECT o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) AS unverified, row_number() OVER (ORDER BY o_orderstatus <> 'F', o_custkey, o_orderpriority, o_orderkey) - 1 AS place FROM orders")
def store_order(spark, d):
    """The order of the published store: verified ones first, by institution, subject and programme."""
    rows = parquet(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") != "F").cast("int").alias("unverified"), "o_custkey", "o_orderpriority")
    return dedup.global_position(rows, ["unverified", "o_custkey", "o_orderpriority", "o_orderkey"], "place").select("o_orderkey", "unverified", "place")


@query("SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS i FROM customer) JOIN (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i FROM orders) USING (i) WHERE c_mktsegment[1:1] = CASE o_orderpriority[1:1] WHEN '1' THEN 'A' WHEN '2' THEN 'B' WHEN '3' THEN 'F' WHEN '4' THEN 'H' ELSE 'M' END")
def join_by_position(spark, d):
    """Rows of two boards joined by board and place, never by displayed rank."""
    c = dedup.batches(parquet(spark, d, "customer").select("c_custkey", F.left("c_mktsegment", F.lit(1)).alias("board")), ["board"], [F.col("c_custkey")], 1).select("c_custkey", "board", F.col("batch_no").alias("i"))
    board = text.mapped(F.left("o_orderpriority", F.lit(1)), dict(zip("12345", "ABFHM", strict=True)))
    o = dedup.batches(parquet(spark, d, "orders").select("o_orderkey", board.alias("board")), ["board"], [F.col("o_orderkey")], 1).select("o_orderkey", "board", F.col("batch_no").alias("i"))
    return c.join(o, ["board", "i"]).select("c_custkey", "o_orderkey")
