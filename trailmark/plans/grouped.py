"""Aggregations and set operations over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import aggregates, joins, mining, rewards, scans, scoring

from .registry import query


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 9) AS fraction FROM orders GROUP BY 1, 2")
def value_counts(load):
    return aggregates.value_counts(load("orders"), ["o_orderstatus"], "o_orderpriority").withColumn("fraction", F.round("fraction", 9))


@query("""
    WITH d AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS kinds, count(*) AS n FROM orders GROUP BY 1)
    SELECT kinds, count(*) AS customers, count(*) FILTER (kinds = 1) AS uniform, max(n) AS most FROM d GROUP BY 1""")
def diversity_of_groups(load):
    d = load("orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("kinds"), F.count(F.lit(1)).alias("n"))
    return d.groupBy("kinds").agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.col("kinds") == 1).alias("uniform"), F.max("n").alias("most"))


@query("""
    SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_pop(l_quantity), 6) AS l_quantity_std, round(max(l_quantity) - min(l_quantity), 6) AS l_quantity_range,
      round(avg(l_extendedprice), 4) AS l_extendedprice_mean, round(stddev_pop(l_extendedprice), 4) AS l_extendedprice_std, round(max(l_extendedprice) - min(l_extendedprice), 4) AS l_extendedprice_range
    FROM lineitem GROUP BY 1""")
def spread_by_group(load):
    out = aggregates.spread(load("lineitem"), ["l_returnflag"], ["l_quantity", "l_extendedprice"])
    return out.select("l_returnflag", "n", *[F.round(c, 6 if "quantity" in c else 4).alias(c) for c in out.columns[2:]])


@query("""
    WITH a AS (SELECT l_orderkey, any_value(l_suppkey % 10) AS g, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) AS v FROM lineitem GROUP BY 1),
         g AS (SELECT l_orderkey % 10 AS g, v, len(v) AS k FROM a), m AS (SELECT g, k, count(*) AS n FROM g GROUP BY 1, 2),
         b AS (SELECT g, arg_max(k, n * 1000 + k) AS k FROM m GROUP BY 1), e AS (SELECT g, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS position FROM g JOIN b USING (g, k))
    SELECT g, position, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x) AS least, max(x) AS most FROM e GROUP BY 1, 2""")
def elementwise_over_arrays(load):
    items = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")))
    a = load("lineitem").groupBy("l_orderkey").agg(items.alias("s")).select((F.col("l_orderkey") % 10).alias("g"), F.transform("s", lambda x: x["l_quantity"]).alias("v"))
    out = aggregates.elementwise(a, ["g"], "v")
    return out.select("g", "position", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "least", "most")


@query("""
    WITH c AS (SELECT user_id, event_type, avg(value) AS m FROM events GROUP BY 1, 2)
    SELECT event_type, round(quantile_cont(m, 0.5), 6) AS median, round(quantile_cont(m, 0.9), 6) AS p90, round(max(m), 6) AS most FROM c GROUP BY 1""")
def two_level_percentiles(load):
    c = load("events").groupBy("user_id", "event_type").agg(F.avg("value").alias("m"))
    p = aggregates.percentiles(c, ["event_type"], "m", {"median": 0.5, "p90": 0.9, "most": 1.0})
    return p.select("event_type", *[F.round(n, 6).alias(n) for n in ("median", "p90", "most")])


@query("""
    WITH s AS (SELECT user_id, list(value ORDER BY value) AS v FROM events GROUP BY 1)
    SELECT user_id, v[round_even(0.9 * (len(v) - 1), 0)::INT + 1] AS nearest, v[floor(0.9 * (len(v) - 1))::INT + 1] AS floored FROM s""")
def rank_percentiles(load):
    picked = [aggregates.percentiles(load("events"), ["user_id"], "value", {kind: 0.9}, how) for kind, how in (("nearest", "nearest"), ("floored", "floor"))]
    return picked[0].join(picked[1], "user_id")


@query("""
    SELECT l_shipdate::DATE AS day, count(*) AS n, count(*) FILTER (l_quantity >= 10 AND l_discount <= 0.08 AND l_tax <= 0.06) AS qualified,
      count(*) FILTER (l_quantity < 10) AS failed_quantity, count(*) FILTER (l_discount > 0.08) AS failed_discount, count(*) FILTER (l_tax > 0.06) AS failed_tax FROM lineitem GROUP BY 1""")
def gate_deaths(load):
    gates = {"quantity": F.col("l_quantity") >= 10, "discount": F.col("l_discount") <= 0.08, "tax": F.col("l_tax") <= 0.06}
    return aggregates.gates(load("lineitem").withColumn("day", F.to_date("l_shipdate")), ["day"], gates)


@query("""
    SELECT l_orderkey, l_linenumber, round((sum(l_quantity) OVER w - l_quantity) / nullif(count(*) OVER w - 1, 0), 6) AS others_mean,
      round(abs(l_quantity - (sum(l_quantity) OVER w - l_quantity) / nullif(count(*) OVER w - 1, 0)), 6) AS deviation FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""")
def leave_one_out(load):
    out = aggregates.leave_one_out(load("lineitem"), ["l_orderkey"], "l_quantity")
    return out.select("l_orderkey", "l_linenumber", F.round("others_mean", 6).alias("others_mean"), F.round("deviation", 6).alias("deviation"))


@query("""
    WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events), c AS (SELECT user_id, event_type, count(*) AS n, min(r) AS f FROM s GROUP BY 1, 2)
    SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k FROM c) WHERE k = 1""")
def majority_first_seen(load):
    return aggregates.majority(load("events"), ["user_id"], "event_type", [F.col("event_id")])


@query("""
    WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2)
    SELECT p_brand, p_type, n, rank, n_unique, total FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS rank, count(*) OVER (PARTITION BY p_brand) AS n_unique,
      (sum(n) OVER (PARTITION BY p_brand))::BIGINT AS total FROM c) WHERE rank <= 3""")
def most_common_values(load):
    return aggregates.most_common(load("part"), ["p_brand"], "p_type", 3)


@query("""
    WITH p AS (SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b, abs(a.l_quantity - b.l_quantity) AS d FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber),
         m AS (SELECT l_orderkey, x AS member, avg(d) AS mean_distance FROM (SELECT l_orderkey, a AS x, d FROM p UNION ALL SELECT l_orderkey, b, d FROM p) GROUP BY 1, 2)
    SELECT l_orderkey, member, round(mean_distance, 6) AS mean_distance FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY mean_distance, member) AS k FROM m) WHERE k = 1""")
def medoids(load):
    out = aggregates.medoid_within(load("lineitem"), ["l_orderkey"], "l_linenumber", "l_quantity", lambda a, b: F.abs(a - b))
    return out.withColumn("mean_distance", F.round("mean_distance", 6))


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(load):
    return aggregates.repeated_keys(load("lineitem"), ["l_partkey", "l_suppkey"])


@query("""
    WITH b AS (SELECT CASE WHEN value < 10 THEN 1 WHEN value < 50 THEN 2 WHEN value < 150 THEN 3 ELSE 0 END AS bin FROM events)
    SELECT bin, count(*) AS n, round(sum(count(*)) OVER () / (4 * count(*)), 9) AS weight FROM b GROUP BY 1""")
def inverse_frequency_weights(load):
    bins = F.when(F.col("value") < 10, 1).when(F.col("value") < 50, 2).when(F.col("value") < 150, 3).otherwise(0)
    return aggregates.inverse_frequency(load("events"), bins, 4).withColumn("weight", F.round("weight", 9))


@query("""
    WITH w AS (SELECT lower(trim(unnest(string_split(text, ' ')))) AS word, length(text) AS size FROM conversations)
    SELECT word, count(*) AS n, round(avg(size), 6) AS mean_size FROM w WHERE word <> '' GROUP BY 1 HAVING count(*) >= 3 ORDER BY mean_size DESC, word LIMIT 10""")
def impactful_words(load):
    w = load("conversations").select(F.explode(F.split("text", " ")).alias("w"), F.char_length("text").alias("size")).select(F.lower(F.trim("w")).alias("word"), "size").where("word <> ''")
    means = w.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("size"), 6).alias("mean_size")).where("n >= 3")
    return means.orderBy(F.desc("mean_size"), "word").limit(10)


@query("""
    WITH RECURSIVE s AS (SELECT user_id, value / 100 AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
      e AS (SELECT user_id, 0::BIGINT AS r, 0.6::DOUBLE AS ema FROM s WHERE r = 1 UNION ALL SELECT e.user_id, e.r + 1, greatest(0.35, least(0.8, e.ema * (1 - 0.02) + s.v * 0.02)) FROM e JOIN s ON s.user_id = e.user_id AND s.r = e.r + 1)
    SELECT user_id, round(arg_max(ema, r), 9) AS ema FROM e GROUP BY 1""")
def clamped_moving_average(load):
    e = load("events").withColumn("v", F.col("value") / 100)
    return aggregates.smoothed(e, ["user_id"], ["event_id"], "v", 0.02, 0.6, 0.35, 0.8).withColumn("ema", F.round("ema", 9))


@query("""
    WITH r AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Perfect' ELSE 'Failed - Agent crashed' END AS status, o_totalprice AS score, count(*) FILTER (l_returnflag = 'R') AS bad
               FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3)
    SELECT count(*) AS routes, round(avg(score), 4) AS driving_score, round(avg((status = 'Perfect' OR (status = 'Completed' AND bad = 0))::INT), 9) AS success_rate FROM r WHERE status NOT LIKE '%Agent crashed%'""")
def merged_route_scores(load):
    li = load("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("bad"), F.collect_list("l_linenumber").alias("slow"))
    status = F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "Perfect").otherwise("Failed - Agent crashed")
    routes = load("orders").join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(status.alias("status"), F.col("o_totalprice").alias("score_composed"), F.create_map(F.lit("collisions"), "bad", F.lit("min_speed_infractions"), "slow").alias("infractions"))
    return scoring.merged(routes).select("routes", F.round("driving_score", 4).alias("driving_score"), F.round("success_rate", 9).alias("success_rate"))


@query("""
    WITH a(scenario, ability) AS (VALUES ('click', 'touch'), ('view', 'look'), ('view', 'signs'), ('view', 'signs'), ('purchase', 'touch'), ('error', 'signs'))
    SELECT ability, count(*) AS n, round(avg((value > 50)::INT), 9) AS rate FROM events JOIN a ON event_type = scenario GROUP BY 1""")
def ability_rates(load):
    e = load("events").withColumn("good", F.col("value") > 50)
    a = e.sparkSession.createDataFrame([("click", "touch"), ("view", "look"), ("view", "signs"), ("view", "signs"), ("purchase", "touch"), ("error", "signs")], "event_type string, ability string")
    return scoring.ability_rates(e, "event_type", "good", a).withColumn("rate", F.round("rate", 9))


@query("""
    WITH r AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS red, count(*) FILTER (l_discount > 0.08) AS ped, sum(l_quantity) / 100 AS km FROM lineitem GROUP BY 1)
    SELECT l_orderkey % 20 AS town, round(avg(0.7 ** (red / km) * 0.5 ** (ped / km) * (1 - least(ped, 5) / 100)), 9) AS score, round(sum(red) / sum(km), 9) AS red_per_km FROM r GROUP BY 1""")
def infractions_per_km(load):
    li = load("lineitem")
    r = li.groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_returnflag") == "R", 1)).alias("red"), F.collect_list(F.when(F.col("l_discount") > 0.08, 1)).alias("ped"), (F.sum("l_quantity") / 100).alias("km"))
    p = scoring.penalty(F.create_map(F.lit("red_light"), "red", F.lit("collisions_pedestrian"), "ped"), F.col("km")) * scoring.lane_penalty(F.least(F.size("ped"), F.lit(5)))
    return r.groupBy((F.col("l_orderkey") % 20).alias("town")).agg(F.round(F.avg(p), 9).alias("score"), F.round(F.sum(F.size("red")) / F.sum("km"), 9).alias("red_per_km"))


@query("""
    SELECT o_custkey, o_orderkey, round(avg(o_totalprice) OVER w, 4) AS running_mean, round(sum(o_totalprice) OVER w, 2) AS running_total FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""")
def running_means(load):
    price = F.col("o_totalprice")
    order = [F.col(c).asc() for c in ("o_orderdate", "o_orderkey")]
    o = load("orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    o = scans.running(o, ["o_custkey"], order, {"sum": scans.total(price), "n": scans.total(F.when(price.isNotNull(), 1))})
    return o.select("o_custkey", "o_orderkey", F.round(F.col("sum") / F.col("n"), 4).alias("running_mean"), F.round("sum", 2).alias("running_total"))


@query("""
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, round(avg(l_discount), 9) AS mean_discount
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def pricing_rollup(load):
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return load("lineitem").where("l_shipdate <= timestamp '1998-09-02'").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(revenue), 4).alias("revenue"), F.round(F.avg("l_discount"), 9).alias("mean_discount"))


@query("""
    SELECT n_name, EXTRACT(year FROM o_orderdate) AS year, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, count(DISTINCT o_custkey) AS buyers
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""")
def revenue_by_nation_and_year(load):
    suppliers = load("supplier").join(F.broadcast(load("nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    joined = load("lineitem").join(load("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy("n_name", F.year("o_orderdate").cast("long").alias("year")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"), F.countDistinct("o_custkey").alias("buyers"))


@query("""
    WITH f AS (SELECT user_id, event_type AS kind, CASE WHEN value > 60 THEN 'PASS' WHEN value < 20 THEN 'FAIL' ELSE 'ABSTAIN' END AS verdict FROM events),
         t AS (SELECT user_id, count(*) FILTER (kind <> 'error' AND verdict = 'PASS') AS ap, count(*) FILTER (kind <> 'error' AND verdict = 'FAIL') AS af,
                      count(*) FILTER (kind = 'error' AND verdict = 'PASS') AS cp, count(*) FILTER (kind = 'error' AND verdict = 'FAIL') AS cf, count(*) FILTER (verdict = 'ABSTAIN') / count(*) AS u FROM f GROUP BY 1),
         p AS (SELECT user_id, u, ap / nullif(ap + af, 0) AS a, cp / nullif(cp + cf, 0) AS c FROM t)
    SELECT user_id, round(a, 9) AS atomic_precision, round(c, 9) AS causal_precision,
      round(CASE WHEN a IS NOT NULL OR c IS NOT NULL THEN greatest(0, (coalesce(0.7 * a, 0) + coalesce(0.3 * c, 0)) / ((a IS NOT NULL)::INT * 0.7 + (c IS NOT NULL)::INT * 0.3) - 0.1 * u) END, 9) AS reward FROM p""")
def verdict_rewards(load):
    verdict = F.when(F.col("value") > 60, "PASS").when(F.col("value") < 20, "FAIL").otherwise("ABSTAIN")
    f = load("events").select("user_id", F.when(F.col("event_type") == "error", "causal").otherwise("atomic").alias("kind"), verdict.alias("verdict"))
    t = rewards.tally(f, ["user_id"], "kind", "verdict")
    total = sum(F.col(f"{k}_{v}") for k in ("atomic", "causal") for v in ("pass", "fail", "abstain"))
    unparsed = (F.col("atomic_abstain") + F.col("causal_abstain")) / total
    reward = rewards.trace_reward(F.col("atomic_precision"), F.col("causal_precision"), unparsed)
    return t.select("user_id", F.round("atomic_precision", 9).alias("atomic_precision"), F.round("causal_precision", 9).alias("causal_precision"), F.round(reward, 9).alias("reward"))


@query("""
    SELECT event_id, round(1 / (1 + exp(-(value - 50) * 0.1)) * (1 / (1 + exp(-(user_id - 70) * 0.1))), 9) AS gate FROM events""")
def soft_gates(load):
    return load("events").select("event_id", F.round(rewards.soft_gate(F.col("value"), F.col("user_id"), 50, 70, 0.1), 9).alias("gate"))


@query("""
    WITH v AS (SELECT user_id, event_id, CASE WHEN value < 200 THEN value ELSE 'NaN'::DOUBLE END AS v FROM events)
    SELECT event_id, round(CASE WHEN isnan(v) THEN coalesce(avg(v) FILTER (NOT isnan(v)) OVER (PARTITION BY user_id), 0.5) ELSE v END, 6) AS v FROM v""")
def group_mean_for_nan(load):
    v = load("events").select("user_id", "event_id", F.when(F.col("value") < 200, F.col("value")).otherwise(F.lit(float("nan"))).alias("v"))
    return rewards.fill_from_group(v, ["user_id"], "v", F.lit(0.5)).select("event_id", F.round("v", 6).alias("v"))


@query("""
    SELECT o_orderkey, preferred, abs(a - b) AS margin, CASE WHEN preferred <> 'tie' THEN preferred = 'chosen' END AS agrees FROM (
      SELECT o_orderkey, o_custkey % 5 AS a, o_custkey % 7 AS b, ('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT % 2 = 1 AS s,
        CASE WHEN o_custkey % 5 = o_custkey % 7 THEN 'tie' WHEN (o_custkey % 5 > o_custkey % 7) <> (('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT % 2 = 1) THEN 'chosen' ELSE 'rejected' END AS preferred FROM orders)""")
def judged_pairs(load):
    from trailmark.functions import hashing

    a, b, s = F.col("o_custkey") % 5, F.col("o_custkey") % 7, hashing.swap_parity(F.col("o_orderkey"))
    told = F.when(a == b, "tie").when(a > b, "first").otherwise("second")
    return load("orders").select("o_orderkey", *[c.alias(n) for n, c in rewards.judged(told, s, a, b).items()])


@query("""
    WITH s AS (SELECT l_orderkey, l_orderkey % 8 AS cluster, l_linenumber, l_quantity AS v FROM lineitem WHERE l_returnflag <> 'R'),
         c AS (SELECT l_orderkey, l_quantity AS v FROM lineitem WHERE l_returnflag = 'R'),
         p AS (SELECT a.l_orderkey, a.cluster, abs(a.v - b.v) AS d FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber),
         f AS (SELECT l_orderkey, cluster, avg(d) AS m, stddev_pop(d) AS sd, quantile_cont(d, 0.9) AS sf FROM p GROUP BY 1, 2),
         k AS (SELECT cluster, quantile_cont(sf, 0.9) AS cf FROM f GROUP BY 1), x AS (SELECT l_orderkey, avg(abs(s.v - c.v)) AS cross_d FROM s JOIN c USING (l_orderkey) GROUP BY 1)
    SELECT l_orderkey, cluster, round(cross_d, 6) AS "cross", round(sf, 6) AS scene_floor, round(cf, 6) AS cluster_floor, round((cross_d - m) / nullif(sd, 0), 6) AS z FROM f JOIN k USING (cluster) JOIN x USING (l_orderkey) WHERE cross_d > greatest(sf, cf)""")
def mined_pairs(load):
    li = load("lineitem").withColumn("cluster", F.col("l_orderkey") % 8)
    clean, changed = li.where("l_returnflag <> 'R'"), li.where("l_returnflag = 'R'")
    floors = mining.scene_floors(clean, "l_orderkey", "cluster", "l_linenumber", "l_quantity")
    out = mining.qualified(floors, mining.cross_distance(clean, changed, "l_orderkey", "l_quantity"), "l_orderkey", "cluster")
    return out.select("l_orderkey", "cluster", *[F.round(c, 6).alias(c) for c in ("cross", "scene_floor", "cluster_floor", "z")])


@query("""
    WITH c AS (SELECT min(vec_id) AS other FROM embeddings GROUP BY label)
    SELECT v.vec_id, c.other, round(list_cosine_similarity(v.embedding::DOUBLE[], a.embedding::DOUBLE[]), 6) AS similarity, v.label = a.label AS same FROM embeddings v JOIN c ON v.vec_id <> c.other JOIN embeddings a ON a.vec_id = c.other""")
def anchor_similarities(load):
    """Every vector against every label's anchor, the vector of its least id."""
    e = load("embeddings").select("vec_id", "label", "embedding")
    anchors = e.groupBy(F.col("label").alias("l")).agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("a"))
    pairs = joins.all_pairs(e, anchors.select("l", F.col("a.vec_id").alias("other"), F.col("a.embedding").alias("x"))).where("vec_id <> other")
    return pairs.select("vec_id", "other", F.round(rewards.cosine(F.col("embedding"), F.col("x")), 6).alias("similarity"), (F.col("label") == F.col("l")).alias("same"))


@query("""
    SELECT v.vec_id, c.vec_id AS other, round(list_cosine_similarity(v.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS similarity, v.label = c.label AS same
    FROM embeddings v JOIN embeddings c ON v.vec_id <> c.vec_id AND c.vec_id % 20 = 0""")
def search_similarities(load):
    """Every twentieth vector against all others."""
    e = load("embeddings").select("vec_id", "label", "embedding")
    searched = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("other"), F.col("label").alias("l"), F.col("embedding").alias("x"))
    pairs = joins.similarities(e, searched, "embedding", "x").where("vec_id <> other")
    return pairs.select("vec_id", "other", F.round("similarity", 6).alias("similarity"), (F.col("label") == F.col("l")).alias("same"))


@query("SELECT o_custkey AS id, 'big' AS arm FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT o_custkey, 'small' FROM orders WHERE o_totalprice < 50000")
def tagged_union(load):
    o = load("orders").select(F.col("o_custkey").alias("id"), "o_totalprice")
    return o.where("o_totalprice > 300000").select("id", F.lit("big").alias("arm")).unionByName(o.where("o_totalprice < 50000").select("id", F.lit("small").alias("arm")))


@query("""
    (SELECT o_custkey AS id, 'both' AS side FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey, 'both' FROM orders WHERE o_orderstatus = 'O')
    UNION ALL (SELECT o_custkey, 'only_f' FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey, 'only_f' FROM orders WHERE o_orderstatus = 'O')""")
def intersection_and_difference(load):
    o = load("orders")
    f, p = (o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("id")) for s in "FO")
    return f.intersect(p).withColumn("side", F.lit("both")).unionByName(f.subtract(p).withColumn("side", F.lit("only_f")))


@query("""
    WITH w AS (SELECT conv_id, turn, lower(role) AS word FROM conversations), f AS (SELECT conv_id, word, min(turn) AS t FROM w GROUP BY 1, 2)
    SELECT conv_id, string_agg(word, ',' ORDER BY t, word) AS words FROM f GROUP BY 1""")
def ordered_distinct(load):
    f = load("conversations").groupBy("conv_id", F.lower("role").alias("word")).agg(F.min("turn").alias("t"))
    return f.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t", "word"))), lambda x: x["word"]), ",").alias("words"))


@query("""
    SELECT l_orderkey, len(list_filter(list_distinct(list(l_returnflag)), lambda x: x NOT IN ('N', 'A'))) = 0 AS known FROM lineitem GROUP BY 1""")
def subset_test(load):
    known = F.array(F.lit("N"), F.lit("A"))
    return load("lineitem").groupBy("l_orderkey").agg((F.size(F.array_except(F.collect_set("l_returnflag"), known)) == 0).alias("known"))
