"""Text helpers, reshaping and nesting over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trailmark.functions import statistics, text
from trailmark.functions.times import micros
from trailmark.sources import tables

from .registry import query


@query("""
    SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), ';|,? then\\b|\\. '), lambda b: trim(b)), lambda b: b <> '')) AS beats FROM documents""")
def sentence_beats(load):
    return load("documents").select("doc_id", F.size(text.beats(F.coalesce("text", F.lit("")))).cast("long").alias("beats"))


@query("""
    SELECT conv_id, turn, lower(coalesce(nullif(regexp_extract(text, '(?i)(?:^|[^\\pL\\pN_])(because|since|as)(?:[^\\pL\\pN_]|$)', 1), ''), nullif(regexp_extract(text, '(?i)(?:^|[^\\pL\\pN_])(after|for|the)(?:[^\\pL\\pN_]|$)', 1), ''))) AS connective FROM conversations""")
def first_connectives(load):
    return load("conversations").select("conv_id", "turn", text.first_connective(F.col("text"), ["because", "since", "as"], ["after", "for", "the"]).alias("connective"))


@query("""
    SELECT event_id, (regexp_extract(props, '(-?[0-9]+)', 1))::BIGINT AS only, (regexp_extract(props, '(-?[0-9]+)', 1))::DOUBLE AS first FROM events""")
def numbers_in_messages(load):
    return load("events").select("event_id", text.only_integer(F.col("props")).alias("only"), text.nth_number(F.col("props"), 1).alias("first"))


@query("SELECT p_partkey, regexp_replace(p_name, '[^\\p{L}\\p{N}]', '_', 'g') AS key, p_name LIKE 'Part%1_' AS hit FROM part")
def safe_keys_and_globs(load):
    return load("part").select("p_partkey", text.safe_key(F.col("p_name")).alias("key"), text.glob(F.col("p_name"), "Part*1?").alias("hit"))


@query("""
    WITH s AS (SELECT user_id || '_' || event_type || '_' || epoch_us(ts) AS scene FROM events)
    SELECT scene, regexp_extract(scene, '^(.+)_([0-9]+)$', 1) AS clip, (regexp_extract(scene, '^(.+)_([0-9]+)$', 2))::BIGINT AS t0 FROM s""")
def scene_ids(load):
    s = load("events").select(F.concat_ws("_", F.col("user_id").cast("string"), "event_type", micros(F.col("ts")).cast("string")).alias("scene"))
    clip, t0 = text.scene_parts(F.col("scene"))
    return s.select("scene", clip.alias("clip"), t0.alias("t0"))


@query("SELECT event_id, greatest(0, least(255, round_even(value / (400.0 / 255), 0)))::INT AS bin, round(greatest(0, least(255, round_even(value / (400.0 / 255), 0))) * (400.0 / 255), 6) AS level FROM events")
def quantised_values(load):
    q = statistics.quantise(F.col("value"), 0.0, 400.0, 256)
    return load("events").select("event_id", q.alias("bin"), F.round(statistics.dequantise(q, 0.0, 400.0, 256), 6).alias("level"))


@query("SELECT event_id, (json_extract(props, '$.k'))::INT AS k, value > 100 AS big FROM events WHERE (json_extract(props, '$.k'))::INT >= 50")
def json_fields(load):
    k = F.from_json("props", "k int")["k"]
    return load("events").select("event_id", k.alias("k"), (F.col("value") > 100).alias("big")).where("k >= 50")


@query("""
    WITH c AS (SELECT user_id, list(struct_pack(event_start_timestamp := epoch_us(ts), coc := event_type) ORDER BY ts, event_id) AS ev FROM events WHERE value > 150 GROUP BY 1)
    SELECT u.user_id, e.i AS event_idx, e.x.event_start_timestamp AS t, e.x.coc AS coc FROM (SELECT DISTINCT user_id FROM events) u JOIN (SELECT user_id, unnest(ev) AS x, (generate_subscripts(ev, 1) - 1)::INT AS i FROM c) e ON u.user_id = e.user_id""")
def exploded_event_cells(load):
    """Events as JSON cells (None where a user has none), parsed and numbered."""
    e = load("events")
    cell = F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: F.struct(micros(x["ts"]).alias("event_start_timestamp"), x["event_type"].alias("coc"))))
    cells = e.select("user_id").distinct().join(e.where("value > 150").groupBy("user_id").agg(cell.alias("cell")), "user_id", "left").withColumn("cell", F.coalesce("cell", F.lit("None")))
    return cells.select("user_id", F.posexplode(tables.events_cell(F.col("cell"))).alias("event_idx", "x")).select("user_id", "event_idx", F.col("x.event_start_timestamp").alias("t"), F.col("x.coc").alias("coc"))


@query("""
    WITH b AS (SELECT l_orderkey, l_linenumber, unnest(list_filter([CASE WHEN l_quantity > 40 THEN 'bulk' END, CASE WHEN l_discount > 0.07 THEN 'promo' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END, 'all'], lambda x: x IS NOT NULL)) AS bucket FROM lineitem)
    SELECT bucket, count(*) AS members, count(DISTINCT l_orderkey) AS orders, round(count(*) / (SELECT count(*) FROM lineitem), 9) AS share FROM b GROUP BY 1""")
def multi_label_buckets(load):
    li = load("lineitem")
    names = F.array_compact(F.array(F.when(F.col("l_quantity") > 40, "bulk"), F.when(F.col("l_discount") > 0.07, "promo"), F.when(F.col("l_returnflag") == "R", "returned"), F.lit("all")))
    sizes = li.select("l_orderkey", F.explode(names).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.countDistinct("l_orderkey").alias("orders"))
    total = li.agg(F.count(F.lit(1)).alias("t"))
    return sizes.join(F.broadcast(total)).withColumn("share", F.round(F.col("members") / F.col("t"), 9)).drop("t")


@query("""
    SELECT user_id, round(sum(value) FILTER (event_type = 'click'), 4) AS click, round(sum(value) FILTER (event_type = 'view'), 4) AS "view", round(sum(value) FILTER (event_type = 'purchase'), 4) AS purchase FROM events GROUP BY 1""")
def pivoted_grid(load):
    p = load("events").groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).agg(F.sum("value"))
    return p.select("user_id", *[F.round(c, 4).alias(c) for c in ("click", "view", "purchase")])


@query("""
    SELECT r_name, string_agg(n_name, '|' ORDER BY n_name) AS nations, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def nested_lists(load):
    j = load("nation").join(F.broadcast(load("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.array_join(F.sort_array(F.collect_list("n_name")), "|").alias("nations"), F.count(F.lit(1)).alias("n"))


@query("""
    WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events)
    SELECT user_id, round(max(value) FILTER (k = 1), 4) AS r1, round(max(value) FILTER (k = 2), 4) AS r2, round(max(value) FILTER (k = 3), 4) AS r3, round(max(value) FILTER (k = 200), 4) AS r200 FROM r GROUP BY 1""")
def ranked_matrix(load):
    r = load("events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))).where(F.col("k").isin(1, 2, 3, 200))
    p = r.groupBy("user_id").pivot("k", [1, 2, 3, 200]).agg(F.max("value"))
    return p.select("user_id", *[F.round(F.col(str(k)), 4).alias(f"r{k}") for k in (1, 2, 3, 200)])


@query("""
    SELECT c_custkey, o AS owner, ((row_number() OVER w - 1) // 50)::BIGINT AS shard, ((row_number() OVER w - 1) % 50)::INT AS slot FROM (SELECT c_custkey, (('0x' || md5(c_custkey::VARCHAR))::UHUGEINT % 16)::BIGINT AS o FROM customer) WINDOW w AS (PARTITION BY o ORDER BY c_custkey)""")
def shard_positions(load):
    from trailmark.functions import hashing

    n = F.row_number().over(Window.partitionBy("owner").orderBy("c_custkey")) - 1
    return load("customer").select("c_custkey", hashing.owner(F.col("c_custkey"), 16).alias("owner")).select("c_custkey", "owner", F.floor(n / 50).alias("shard"), (n % 50).alias("slot"))


@query("""
    SELECT source, lang, count(*) AS documents, sum(length(coalesce(text, ''))) AS characters, count(DISTINCT md5(coalesce(text, ''))) AS texts, count(*) FILTER (quality = 0) AS poor
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""")
def corpus_summary(load):
    d = load("documents").join(load("labels"), "doc_id", "left")
    t = F.coalesce("text", F.lit(""))
    return d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.char_length(t)).alias("characters"), F.countDistinct(F.md5(t)).alias("texts"), F.count_if(F.col("quality") == 0).alias("poor"))


@query("""
    SELECT conv_id, count(*) AS turns, string_agg(upper(substr(role, 1, 1)), '' ORDER BY turn) AS pattern, round(avg(length(text)) FILTER (role = 'user'), 6) AS user_size FROM conversations GROUP BY 1""")
def conversation_shapes(load):
    order = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: F.upper(F.substring(x["role"], 1, 1))), "")
    return load("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), order.alias("pattern"), F.round(F.avg(F.when(F.col("role") == "user", F.char_length("text"))), 6).alias("user_size"))
