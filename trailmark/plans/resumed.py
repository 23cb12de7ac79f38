"""Mining ranks, streams that resume from a table, and sources that are kept as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import aggregates, mining
from trailmark.session import kept, scratch
from trailmark.sources import pickles, tables
from trailmark.streaming import events as streams

from .registry import ORACLES, query
from .sequences import _stream


@query("""
    WITH s AS (SELECT l_orderkey, l_orderkey % 8 AS cluster, l_linenumber, l_quantity AS v FROM lineitem WHERE l_returnflag <> 'R'),
         c AS (SELECT l_orderkey, (l_suppkey % 4)::INT AS condition, l_quantity AS v FROM lineitem WHERE l_returnflag = 'R'),
         p AS (SELECT a.l_orderkey, a.cluster, abs(a.v - b.v) AS d FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber),
         f AS (SELECT l_orderkey, cluster, avg(d) AS m, stddev_pop(d) AS sd, quantile_cont(d, 0.9) AS sf FROM p GROUP BY 1, 2),
         k AS (SELECT cluster, quantile_cont(sf, 0.9) AS cf FROM f GROUP BY 1),
         x AS (SELECT l_orderkey, condition, avg(abs(s.v - c.v)) AS cross_d FROM s JOIN c USING (l_orderkey) GROUP BY 1, 2),
         q AS (SELECT l_orderkey, cluster, condition, round(cross_d, 6) AS cross_d, round((cross_d - m) / nullif(sd, 0), 6) AS z FROM f JOIN k USING (cluster) JOIN x USING (l_orderkey) WHERE cross_d > greatest(sf, cf))
    SELECT l_orderkey, cluster, condition, cross_d AS "cross", z, row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(z, 0) DESC, cross_d DESC, condition) AS rank_within_scene,
      row_number() OVER (PARTITION BY cluster ORDER BY coalesce(z, 0) DESC, cross_d DESC, l_orderkey, condition) AS rank_within_cluster FROM q""")
def ranked_pairs(load):
    """Pairs of a scene and each of its changed conditions: floors of scenes and clusters
    first, then what is above both, ranked in its scene and its cluster."""
    li = load("lineitem").withColumn("cluster", F.col("l_orderkey") % 8).withColumn("condition", (F.col("l_suppkey") % 4).cast("int"))
    clean, changed = li.where("l_returnflag <> 'R'"), li.where("l_returnflag = 'R'")
    floors = mining.scene_floors(clean, "l_orderkey", "cluster", "l_linenumber", "l_quantity")
    cross = mining.cross_distances(clean, changed, "l_orderkey", "condition", "l_quantity")
    pairs = mining.above_floors(floors, cross, "l_orderkey").select("l_orderkey", "cluster", "condition", F.round("cross", 6).alias("cross"), F.round("z", 6).alias("z"))
    return mining.ranked(kept(pairs, "pairs"), "l_orderkey", "cluster", "condition")


@query()
def resumed_averages(load):
    """Running clamped averages that a stream carries on from a table: the events up to a
    day's end are averaged in a batch and written, and later ones come as a stream."""
    e = _stream(load)
    share = F.col("value") / 100
    cut = load("events").agg(F.expr("(min(event_id) + max(event_id)) div 2")).first()[0]
    early = load("events").where(F.col("event_id") <= F.lit(cut)).withColumn("v", share)
    counts = early.groupBy("user_id").agg(F.count("v").alias("n"))
    averages = aggregates.smoothed(early, ["user_id"], ["event_id"], "v", 0.02, 0.6, 0.35, 0.8)
    seed = kept(averages.join(counts, "user_id").select("user_id", "n", "ema"), "seed")
    late = e.where(F.col("event_id") > F.lit(cut)).select("user_id", "event_id", share.alias("v"))
    resumed = streams.seeded_averages(late, "user_id", "event_id", "v", 0.02, 0.6, 0.35, 0.8, seed=seed)
    out = streams.to_table(resumed, scratch(e.sparkSession, "averages"), scratch(e.sparkSession, "averages-state"), "update")
    latest = out.select("user_id", "n", "ema").unionByName(seed).groupBy("user_id").agg(F.max_by("ema", "n").alias("ema"))
    return latest.select("user_id", F.round("ema", 9).alias("ema"))


@query("""
    WITH m AS (SELECT 'status ' || l_linestatus AS bucket, l_orderkey || '/' || l_partkey AS member FROM lineitem WHERE l_quantity > 10 UNION SELECT 'flag ' || l_returnflag, l_orderkey || '/' || l_partkey FROM lineitem)
    SELECT bucket, count(*) AS n FROM m GROUP BY 1 UNION ALL SELECT 'total', count(DISTINCT member) FROM m""")
def pickled_buckets(load):
    """Buckets written as pickled dictionaries, read back as plain values: the members of
    each, and the distinct ones of all."""
    li = load("lineitem")
    member = F.concat_ws("/", "l_orderkey", "l_partkey").alias("member")
    statuses = li.where("l_quantity > 10").select(F.concat(F.lit("status "), "l_linestatus").alias("bucket"), member)
    flags = li.select(F.concat(F.lit("flag "), "l_returnflag").alias("bucket"), member)
    path = scratch(li.sparkSession, "buckets")
    pickles.write_buckets(statuses.unionByName(flags).distinct(), path, "bucket", "member")
    read = pickles.read_buckets(li.sparkSession, path)
    return read.groupBy("bucket").agg(F.count("member").alias("n")).unionByName(read.agg(F.lit("total").alias("bucket"), F.count_distinct("member").alias("n")))


@query("""
    SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'broken' ELSE n_name END AS name, CASE WHEN n_nationkey % 5 <> 0 THEN count(c_custkey) END AS customers
    FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name""")
def scene_folder(load):
    """A JSON file per nation with its customers' number, every fifth cut short: those that
    parse are read, the others named."""
    n = load("nation").select("n_nationkey", "n_name")
    counted = n.join(load("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers")), "n_nationkey", "left")
    document = F.to_json(F.struct("n_nationkey", F.col("n_name").alias("name"), F.coalesce("customers", F.lit(0)).alias("customers")))
    whole = F.when(F.col("n_nationkey") % 5 == 0, F.substring(document, 1, 15)).otherwise(document)
    spark, path = n.sparkSession, scratch(n.sparkSession, "scenes")
    counted.select(F.col("n_nationkey").alias("key"), whole.alias("value")).write.partitionBy("key").text(path)
    read = tables.json_files(spark, path, "n_nationkey int, name string, customers long").drop("stem")
    broken = tables.broken_json_files(spark, path).select(F.regexp_extract("path", r"key=(\d+)", 1).cast("int").alias("n_nationkey"), F.lit("broken").alias("name"), F.lit(None).cast("long").alias("customers"))
    return read.unionByName(broken)


@query("SELECT s_suppkey, s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def parquet_in_members(load):
    """Parquet tables that are held as bytes, as in members of archives; the copy at the
    first address is missing, so the second is read."""
    s = load("supplier")
    spark, path = s.sparkSession, scratch(s.sparkSession, "members")
    s.write.option("maxRecordsPerFile", 20_000).parquet(path)
    files = tables.first_of(spark, path + "-mirror", path, fmt="binaryFile").where(F.col("length") > 0)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in s.select("s_suppkey", "s_nationkey", "s_acctbal").schema)
    return tables.parquet_in_bytes(files, "content", schema).withColumn("s_acctbal", F.round("s_acctbal", 2))


@query("""
    SELECT doc_id, quality, 0 AS safety, coalesce(toxic, 0) AS toxic FROM labels""")
def defaulted_columns(load):
    """Columns with defaults for one that the table lacks and for nulls."""
    return tables.projected(load("labels"), {"doc_id": None, "quality": None, "safety": 0, "toxic": 0})


#: The stream and the batch give the same averages, so one statement is both's.
ORACLES["resumed_averages"] = ORACLES["clamped_moving_average"]
