"""Filters, labels and joins over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions import hashing, statistics
from trailmark.functions.times import micros
from trailmark.operators import joins, sampling

from .registry import query


@query("SELECT event_id, user_id, round(value, 2) AS value FROM events WHERE event_type IN ('click', 'purchase') AND value > 100")
def membership_filter(load):
    return load("events").where(F.col("event_type").isin("click", "purchase") & (F.col("value") > 100)).select("event_id", "user_id", F.round("value", 2).alias("value"))


@query("""
    WITH have AS (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS f, bool_or(o_orderstatus = 'O') AS o, bool_or(o_orderpriority LIKE '1%') AS u FROM orders GROUP BY 1)
    SELECT c_custkey, coalesce(f AND o AND u, false) AS complete FROM customer LEFT JOIN have ON c_custkey = o_custkey""")
def required_features(load):
    have = load("orders").groupBy("o_custkey").agg(F.max(F.col("o_orderstatus") == "F").alias("f"), F.max(F.col("o_orderstatus") == "O").alias("o"), F.max(F.col("o_orderpriority").startswith("1")).alias("u"))
    return load("customer").join(have, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce(F.col("f") & F.col("o") & F.col("u"), F.lit(False)).alias("complete"))


@query("""
    SELECT c_mktsegment, count(*) AS n, count(*) FILTER (o_custkey IS NULL) AS dropped
    FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 200000) ON c_custkey = o_custkey GROUP BY 1""")
def dropped_row_accounting(load):
    big = load("orders").where("o_totalprice > 200000").select("o_custkey").distinct()
    return load("customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_custkey").isNull()).alias("dropped"))


@query("""
    WITH t AS (SELECT user_id, event_id, epoch_us(ts) AS t, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS lo, max(epoch_us(ts)) OVER (PARTITION BY user_id) AS hi FROM events)
    SELECT user_id, min(t) AS first_fitting, count(*) AS n FROM t WHERE t > lo + 86400000000 AND t + 172800000000 <= hi GROUP BY user_id""")
def margin_window_first_event(load):
    """First event with enough history before and future after it; the history bound is strict."""
    e = load("events").withColumn("t", micros(F.col("ts")))
    bounds = e.groupBy("user_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    fits = e.join(bounds, "user_id").where("t > lo + 86400000000 and t + 172800000000 <= hi")
    return fits.groupBy("user_id").agg(F.min("t").alias("first_fitting"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity > 5 AND l_quantity < 45) AND l_discount >= 0")
def strict_bounds_with_open_zero(load):
    li = load("lineitem")
    outside = statistics.outside_bounds(F.col("l_quantity"), 5, 45) & ~statistics.outside_bounds(F.col("l_discount") + 1, 0, None)
    return li.where(outside).select("l_orderkey", "l_linenumber")


@query("""
    SELECT l_orderkey, l_linenumber,
      CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_discount > 0.07 THEN 'promoted' WHEN l_quantity > 40 THEN 'bulk' WHEN l_tax > 0.06 THEN 'taxed' ELSE 'plain' END AS label,
      round((l_quantity - 40) / 40, 6) AS bulk_margin, least(abs((l_quantity - 40) / 40), abs((l_discount - 0.07) / 0.07)) <= 0.10 AS ambiguous
    FROM lineitem""")
def priority_labels_with_margins(load):
    bulk, promo = (F.col("l_quantity") - 40) / 40, (F.col("l_discount") - 0.07) / 0.07
    label = F.when(F.col("l_returnflag") == "R", "returned").when(F.col("l_discount") > 0.07, "promoted").when(F.col("l_quantity") > 40, "bulk").when(F.col("l_tax") > 0.06, "taxed").otherwise("plain")
    return load("lineitem").select("l_orderkey", "l_linenumber", label.alias("label"), F.round(bulk, 6).alias("bulk_margin"), (F.least(F.abs(bulk), F.abs(promo)) <= 0.10).alias("ambiguous"))


@query("""
    SELECT o_orderkey, l_partkey, l_suppkey FROM orders LEFT JOIN
      (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn FROM lineitem WHERE l_returnflag = 'N') ON o_orderkey = l_orderkey AND rn = 1""")
def first_match_join(load):
    li = load("lineitem").where("l_returnflag = 'N'").withColumnRenamed("l_orderkey", "o_orderkey")
    return joins.first_match(load("orders").select("o_orderkey"), li, ["o_orderkey"], [F.col("l_linenumber"), F.col("l_partkey")]).select("o_orderkey", "l_partkey", "l_suppkey")


@query("""
    SELECT user_id, bool_or(event_type = 'click') AS has_click, bool_or(event_type = 'view') AS has_view, bool_or(event_type = 'purchase') AS has_purchase,
      bool_or(event_type = 'click') AND bool_or(event_type = 'view') AND bool_or(event_type = 'purchase') AS complete
    FROM events WHERE value > 120 AND event_type IN ('click', 'view', 'purchase') GROUP BY 1""")
def complete_streams(load):
    e = load("events").where("value > 120")
    return joins.complete_only({n: e.where(F.col("event_type") == n) for n in ("click", "view", "purchase")}, "user_id")


@query("""
    WITH o AS (SELECT o_custkey, max(CASE WHEN o_orderpriority LIKE '1%' THEN 'train' ELSE 'val' END) AS split FROM orders WHERE o_totalprice > 250000 GROUP BY 1)
    SELECT c_custkey, coalesce(o.split, CASE WHEN (('0x' || md5(c_custkey::VARCHAR))::UHUGEINT % 1000) < 100 THEN 'val' ELSE 'train' END) AS split
    FROM customer LEFT JOIN o ON c_custkey = o_custkey""")
def split_with_overrides(load):
    o = load("orders").where("o_totalprice > 250000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_orderpriority").startswith("1"), "train").otherwise("val")).alias("split"))
    return joins.left_override(load("customer").select("c_custkey"), o, "c_custkey", "split", hashing.hash_split(F.col("c_custkey"), 0.1))


@query("""
    SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS pending FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)""")
def semi_and_anti_join(load):
    o = load("orders")
    left = load("customer").join(o.where("o_totalprice > 450000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    pending = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("pending", F.lit(True))
    return left.select("c_custkey").join(pending, "c_custkey", "left").withColumn("pending", F.coalesce("pending", F.lit(False)))


@query("""
    WITH a AS (SELECT user_id, arg_min(event_type, event_id) AS label FROM events WHERE value < 60 GROUP BY 1),
         b AS (SELECT user_id, arg_min(event_type, event_id) AS label FROM events WHERE value > 90 GROUP BY 1)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, a.label AS before, b.label AS after, coalesce(a.label <> b.label, true) AS flipped
    FROM a FULL JOIN b ON a.user_id = b.user_id""")
def aligned_labels(load):
    e = load("events")
    first = lambda d: d.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("label"))
    return joins.align(first(e.where("value < 60")), first(e.where("value > 90")), ["user_id"], "label")


@query("""
    SELECT a.l_orderkey, count(*) AS pairs, round(avg(abs(a.l_quantity - b.l_quantity)), 6) AS mean_distance
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY 1""")
def triangular_pairs(load):
    p = joins.pairs_within(load("lineitem"), ["l_orderkey"], "l_linenumber", ["l_quantity"])
    return p.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.abs(F.col("l_quantity_a") - F.col("l_quantity_b"))), 6).alias("mean_distance"))


@query("""
    WITH a AS (SELECT user_id, value AS va, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position FROM events WHERE event_type = 'click'),
         b AS (SELECT user_id, value AS vb, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position FROM events WHERE event_type = 'view')
    SELECT user_id, position, round(abs(va - vb), 6) AS gap FROM a JOIN b USING (user_id, position)""")
def positional_zip(load):
    e = load("events")
    a = e.where("event_type = 'click'").select("user_id", "event_id", F.col("value").alias("va"))
    b = e.where("event_type = 'view'").select("user_id", "event_id", F.col("value").alias("vb"))
    return joins.zip_rows(a, b, ["user_id"], F.col("event_id")).select("user_id", "position", F.round(F.abs(F.col("va") - F.col("vb")), 6).alias("gap"))


@query("""
    WITH r AS (SELECT user_id, event_id AS anchor, epoch_us(ts) AS lo, epoch_us(ts) + 7200000000 AS hi FROM events WHERE event_type = 'signup')
    SELECT user_id, anchor, count(*) AS n, round(max(value), 6) AS most FROM events JOIN r USING (user_id) WHERE epoch_us(ts) BETWEEN lo AND hi GROUP BY 1, 2""")
def interval_join(load):
    e = load("events").withColumn("t", micros(F.col("ts")))
    r = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("anchor"), F.col("t").alias("lo"), (F.col("t") + 7200000000).alias("hi"))
    return joins.within_range(e.select("user_id", "t", "value"), r, ["user_id"], "t", "lo", "hi", 7200000000.0).groupBy("user_id", "anchor").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 6).alias("most"))


_ASOF = """
    WITH q AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), k AS (SELECT user_id, event_id AS known, ts AS kts FROM events WHERE event_type = 'view')
    SELECT event_id, known FROM q ASOF LEFT JOIN k ON q.user_id = k.user_id AND q.ts {op} k.kts"""


def _asof(load, direction):
    e = load("events")
    q = e.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    k = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("known"), "ts")
    return joins.asof(q, k, ["user_id"], "ts", ["known"], direction).select("event_id", "known")


@query(_ASOF.format(op=">="))
def asof_backward(load):
    return _asof(load, "backward")


@query(_ASOF.format(op="<="))
def asof_forward(load):
    return _asof(load, "forward")


@query("""
    WITH q AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase'), k AS (SELECT user_id, event_id AS known, ts AS kts FROM events WHERE event_type = 'view')
    SELECT event_id, arg_min(known, (abs(epoch_us(q.ts) - epoch_us(kts)) * 2 + (kts > q.ts)::INT)) AS known FROM q LEFT JOIN k ON q.user_id = k.user_id GROUP BY 1""")
def nearest_in_time(load):
    e = load("events")
    q = e.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    k = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("known"), "ts")
    return joins.nearest(q, k, ["user_id"], "ts", "known").select("event_id", "known")


@query("""
    SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def dictionary_lookup(load):
    names = load("nation").join(F.broadcast(load("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    totals = load("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.sum("c_acctbal").alias("b"))
    return totals.join(F.broadcast(names), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "r_name", "customers", F.round("b", 2).alias("balance"))


@query("""
    SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON try_cast(split_part(s_name, '#', 2) AS BIGINT) = try_cast(split_part(c_name, '#', 2) AS BIGINT)""")
def join_on_part_of_a_name(load):
    part = lambda c: F.split(c, "#")[1].try_cast("long")
    return load("supplier").join(load("customer"), part("s_name") == part("c_name")).select("s_suppkey", "c_custkey")


@query("""
    SELECT o_orderkey, o_orderpriority, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('quota:' || o_orderkey), o_orderkey) AS rank FROM orders) WHERE rank <= 20""")
def quota_per_stratum(load):
    return sampling.quota(load("orders"), "o_orderpriority", "o_orderkey", 20).select("o_orderkey", "o_orderpriority", "rank")


@query("SELECT l_suppkey, count(*) AS available, 620 - count(*) AS short FROM lineitem GROUP BY 1 HAVING count(*) < 620")
def stratum_shortfalls(load):
    return sampling.shortfalls(load("lineitem"), "l_suppkey", 620)


@query("SELECT o_orderkey FROM orders ORDER BY md5('uniform:' || o_orderkey), o_orderkey LIMIT 100")
def seeded_uniform_sample(load):
    return sampling.uniform(load("orders"), "o_orderkey", 100).select("o_orderkey")


@query("""
    SELECT p_partkey FROM part ORDER BY -ln((('0x' || substr(md5('weighted:' || p_partkey), 1, 12))::BIGINT + 0.5) / 281474976710656.0) / p_retailprice, p_partkey LIMIT 50""")
def weighted_sample(load):
    return sampling.weighted(load("part"), "p_partkey", F.col("p_retailprice"), 50).select("p_partkey")


@query("""
    WITH e AS (SELECT p_partkey, p_size, 5000.0 * p_size / sum(p_size) OVER () AS x FROM part),
         d AS (SELECT p_partkey, (floor(x) + ((('0x' || substr(md5('draws:' || p_partkey), 1, 12))::BIGINT + 0.5) / 281474976710656.0 < x - floor(x))::INT)::BIGINT AS times FROM e)
    SELECT * FROM d WHERE times > 0""")
def weighted_draws_with_replacement(load):
    return sampling.with_replacement(load("part"), "p_partkey", "p_size", 5000)


@query("""
    SELECT c_custkey, (('0x' || md5(c_custkey::VARCHAR))::UHUGEINT % 7)::BIGINT AS owner, CASE WHEN (('0x' || md5(c_custkey::VARCHAR))::UHUGEINT % 1000) < 50 THEN 'val' ELSE 'train' END AS split,
      ('0x' || substr(sha256(c_custkey::VARCHAR), 1, 8))::BIGINT % 2 = 1 AS swapped FROM customer""")
def hash_owners_and_splits(load):
    k = F.col("c_custkey")
    return load("customer").select(k, hashing.owner(k, 7).alias("owner"), hashing.hash_split(k, 0.05).alias("split"), hashing.swap_parity(k).alias("swapped"))


@query("""
    SELECT o_orderkey, o_custkey, o_totalprice, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def top_per_group(load):
    return sampling.top_per_group(load("orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_orderkey", "o_custkey", "o_totalprice", "rank")


@query("""
    (SELECT event_id, value, 'low' AS "end" FROM events ORDER BY value, event_id LIMIT 25) UNION ALL (SELECT event_id, value, 'high' AS "end" FROM events ORDER BY value DESC, event_id DESC LIMIT 25)""")
def top_and_bottom(load):
    return sampling.ends(load("events").select("event_id", "value"), ["value", "event_id"], 25)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def first_per_key(load):
    return sampling.first_per_key(load("events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def newest_per_key(load):
    return sampling.first_per_key(load("orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders WHERE o_orderstatus = 'F') WHERE n % 8 = 3")
def stride_partition(load):
    return sampling.stride(load("orders").where("o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey", 3, 8)


@query()
def greedy_distance_dedup(load):
    """Parts of a brand, less those near an earlier kept one in size and price."""
    p = load("part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 10).alias("y"))
    return sampling.keep_apart(p, ["p_brand"], ["p_partkey"], ["x", "y"], 2.0).select("p_partkey", "p_brand")
