"""Tables written in each source's format to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.session import scratch
from trailmark.sources import archives, recorder, tables, versions, zips

from .registry import query


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def json_lines_scan(load):
    """Orders as gzipped JSON lines, with blank and broken lines between them."""
    o = load("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    path = scratch(o.sparkSession, "lines")
    line = F.to_json(F.struct(*o.columns))
    rest = F.when(F.col("o_orderkey") % 10 == 0, F.array(line, F.lit(""), F.substring(line, 1, 9))).otherwise(F.array(line))
    o.select(F.explode(rest).alias("value")).write.option("compression", "gzip").text(path)
    return tables.json_lines(o.sparkSession, path, "o_orderkey bigint, o_custkey bigint, o_orderpriority string")[0]


@query("SELECT count(*) AS broken FROM orders WHERE o_orderkey % 10 = 0")
def broken_json_lines(load):
    o = load("orders").select("o_orderkey", "o_custkey")
    path = scratch(o.sparkSession, "lines")
    line = F.to_json(F.struct(*o.columns))
    o.select(F.explode(F.when(F.col("o_orderkey") % 10 == 0, F.array(line, F.lit(" "), F.concat(F.lit("{"), line))).otherwise(F.array(line))).alias("value")).write.text(path)
    return tables.json_lines(o.sparkSession, path, "o_orderkey bigint, o_custkey bigint")[1].agg(F.count(F.lit(1)).alias("broken"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error'")
def marked_log_scan(load):
    """Events as payloads in log lines; errors have payloads cut off, and lines without
    the marker are chatter."""
    e = load("events")
    path = scratch(e.sparkSession, "log")
    payload = F.to_json(F.struct("event_id", "user_id", "event_type"))
    said = F.concat(F.lit("12:00 worker RESULT "), F.when(F.col("event_type") == "error", F.substring(payload, 1, 12)).otherwise(payload))
    e.select(F.explode(F.array(said, F.lit("12:00 worker step done"))).alias("value")).write.text(path)
    return tables.marked_lines(e.sparkSession.read.text(path), "RESULT", "event_id bigint, user_id bigint, event_type string")[0]


@query("SELECT 'order ' || o_orderkey AS title, o_orderpriority || chr(10) || o_orderstatus AS quote FROM orders")
def report_scan(load):
    """Orders as sections of Markdown reports with two quoted lines each."""
    o = load("orders")
    path = scratch(o.sparkSession, "reports")
    section = F.concat(F.lit("## order "), F.col("o_orderkey").cast("string"), F.lit("\nsome words\n> "), "o_orderpriority", F.lit("\n>"), "o_orderstatus", F.lit("\n"))
    o.select(section.alias("value")).write.option("maxRecordsPerFile", 5000).text(path)
    return tables.quoted_reports(o.sparkSession, path).select("title", "quote")


@query("""
    SELECT l_orderkey::VARCHAR AS route_id, 'Town' || (l_orderkey % 7) AS town, count(*) AS points, round(sum(l_quantity), 4) AS x, round(sum(l_tax * 100), 4) AS y FROM lineitem GROUP BY 1, 2""")
def xml_route_scan(load):
    """Orders as routes in XML, an item a way point. A file is read by one task, so files
    are bounded."""
    li = load("lineitem")
    path = scratch(li.sparkSession, "routes")
    point = F.struct(F.col("l_quantity").cast("double").alias("_x"), (F.col("l_tax") * 100).cast("double").alias("_y"), F.lit(0.0).alias("_z"))
    routes = li.groupBy("l_orderkey").agg(F.collect_list(point).alias("position"))
    town = F.concat(F.lit("Town"), (F.col("l_orderkey") % 7).cast("string"))
    routes.select(F.col("l_orderkey").cast("string").alias("_id"), town.alias("_town"), F.struct("position").alias("waypoints")).write.format("xml").option("maxRecordsPerFile", 50_000).option("rootTag", "routes").option("rowTag", "route").save(path)
    total = lambda c: F.round(F.aggregate("waypoints", F.lit(0.0), lambda s, p: s + p[c]), 4).alias(c)
    return tables.routes(li.sparkSession, path).select("route_id", "town", F.size("waypoints").cast("long").alias("points"), total("x"), total("y"))


@query("SELECT c_custkey::VARCHAR AS clip, c_name || '|' || c_nationkey AS data FROM customer")
def tar_shard_scan(load):
    """Customers as clips of two members in tar shards; the filter on the extension goes
    into the scan."""
    c = load("customer")
    path = scratch(c.sparkSession, "shards")
    text = F.concat_ws("|", "c_name", F.col("c_nationkey").cast("string"))
    members = c.select(F.lit("train").alias("split"), F.col("c_custkey").cast("string").alias("clip"), F.explode(F.map_from_arrays(F.array(F.lit("txt"), F.lit("bin")), F.array(text, F.lit("x")))).alias("extension", "data"))
    archives.write_tar(members.withColumn("data", F.col("data").cast("binary")), path)
    return archives.read_tar(c.sparkSession, path).where("extension = 'txt'").select("clip", F.col("data").cast("string").alias("data"))


@query("SELECT count(*) AS clips, 2 * count(*) AS members, CASE WHEN count(*) > 0 THEN true END AS starts FROM customer")
def tar_shard_index(load):
    """Where each clip begins: looked up in an index made of headers alone."""
    c = load("customer")
    path = scratch(c.sparkSession, "shards")
    members = c.select(F.lit("train").alias("split"), F.col("c_custkey").cast("string").alias("clip"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("extension"), F.encode("c_name", "utf-8").alias("data"))
    archives.write_tar(members, path)
    found = archives.clip_index(c.sparkSession, path)
    return found.agg(F.count(F.lit(1)).alias("clips"), F.sum("members").alias("members"), F.bool_or(F.col("offset") == 0).alias("starts"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'F'")
def resumed_appends(load):
    """A run that wrote a part before it stopped appends only what is left."""
    o = load("orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = scratch(o.sparkSession, "appended")
    schema = "o_orderkey bigint, o_totalprice double"
    tables.append_json(o.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"), path)
    done = o.sparkSession.read.schema(schema).json(path)
    tables.append_json(tables.remaining(o, done, ["o_orderkey"]).select("o_orderkey", "o_totalprice"), path)
    return o.sparkSession.read.schema(schema).json(path)


@query("SELECT p_partkey, p_name, p_size FROM part")
def csv_round_trip(load):
    p = load("part").select("p_partkey", "p_name", "p_size")
    path = scratch(p.sparkSession, "csv")
    p.write.option("header", True).option("escape", '"').csv(path)
    return p.sparkSession.read.option("header", True).option("escape", '"').schema(p.schema).csv(path)


def _recorder_log(load):
    """Customers' orders as a recorder log per remainder of the customer's key: a frame an
    order, its customer an actor that moves."""
    o = load("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    path = scratch(o.sparkSession, "recorder")
    text = lambda c: F.col(c).cast("string")
    place = F.concat(F.lit("("), text("o_orderkey"), F.lit(", "), text("o_custkey"), F.lit(", 0) Rotation (0, 0, "), (F.col("o_custkey") % 360).cast("string"), F.lit(")"))
    frame = F.concat(
        F.lit("Frame "), text("o_orderkey"), F.lit(" at "), (F.col("o_orderkey") / 10).cast("decimal(18,1)").cast("string"), F.lit(" seconds\n"),
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit(" Create "), text("o_orderkey"), F.lit(": vehicle.kind"), (F.col("o_orderkey") % 3).cast("string"), F.lit(" (1) at (100, 200, 300)\n  role_name = hero\n  color = 1,2,3\n"))).otherwise(""),
        F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit(" Collision id 1 between "), text("o_custkey"), F.lit(" with "), text("o_orderkey"), F.lit("\n"))).otherwise(""),
        F.lit(" Positions: 1\n  Id: "), text("o_custkey"), F.lit(" Location: "), place,
        F.lit("\n Vehicle animations: 1\n  Id: "), text("o_custkey"), F.lit(" Steering: 0.5 Throttle: 0.25 Brake: 0 Handbrake: 0 Gear: "), (F.col("o_custkey") % 5).cast("string"),
        F.lit("\n Current platform time: 1.5\n"),
    )
    o.select(frame.alias("value")).write.text(path)
    return o.sparkSession, path


@query("SELECT o_orderkey AS frame, o_custkey AS actor, round(o_orderkey / 100, 6) AS x, round(o_custkey / 100, 6) AS y, (o_custkey % 360)::DOUBLE AS yaw, 0.25 AS throttle, (o_custkey % 5)::DOUBLE AS gear FROM orders")
def recorder_states(load):
    """Poses and controls from a recorder log."""
    told = recorder.lines(recorder.records(*_recorder_log(load)))
    return recorder.states(told).select("frame", "actor", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "yaw", "throttle", "gear")


@query("SELECT o_orderkey AS actor, 'vehicle.kind' || (o_orderkey % 3) AS type_id, o_orderkey AS created, 'hero' AS role, '1,2,3' AS color FROM orders WHERE o_orderkey % 5 = 0")
def recorder_actors(load):
    told = recorder.lines(recorder.records(*_recorder_log(load)))
    own = F.col("attributes")
    return recorder.actors(told).select("actor", "type_id", "created", own["role_name"].alias("role"), own["color"].alias("color"))


@query("SELECT o_orderkey AS frame, o_custkey AS actor, o_orderkey AS other FROM orders WHERE o_orderkey % 7 = 0")
def recorder_collisions(load):
    return recorder.collisions(recorder.lines(recorder.records(*_recorder_log(load)))).select("frame", "actor", "other")


@query("SELECT c_custkey::VARCHAR AS clip, c_name AS data, c_custkey // 3 AS tag FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey::VARCHAR, c_name, -1 FROM customer WHERE c_custkey % 21 = 0")
def tar_point_lookup(load):
    """Clips read by seeking to where an index of headers says they begin; some are asked for
    twice and some aren't there."""
    c = load("customer")
    path = scratch(c.sparkSession, "shards")
    members = c.select(F.lit("train").alias("split"), F.col("c_custkey").cast("string").alias("clip"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("extension"), F.encode("c_name", "utf-8").alias("data"))
    archives.write_tar(members, path)
    wanted = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("clip"), F.floor(F.col("c_custkey") / 3).alias("tag"))
    more = c.where("c_custkey % 21 = 0").select(F.col("c_custkey").cast("string").alias("clip"), F.lit(-1).cast("long").alias("tag"))
    missing = c.select(F.concat(F.lit("no"), F.col("c_custkey")).alias("clip"), F.lit(0).cast("long").alias("tag"))
    found = archives.lookup(wanted.union(more).union(missing), archives.clip_index(c.sparkSession, path))
    return found.where("extension = 'b'").select("clip", F.col("data").cast("string").alias("data"), "tag")


@query("SELECT c_custkey || '/name.txt' AS member, c_name AS data, strlen(c_name)::BIGINT AS bytes FROM customer WHERE starts_with(c_custkey::VARCHAR, '1')")
def zip_members_by_prefix(load):
    """Customers as two members each in zip archives by nation; of an archive only its directory
    and the wanted members are read."""
    c = load("customer")
    path = scratch(c.sparkSession, "zips")
    text = F.explode(F.map_from_arrays(F.array(F.lit("/name.txt"), F.lit("/rest.bin")), F.array(F.col("c_name"), F.repeat("c_name", F.lit(50)))))
    members = c.select(F.concat(F.lit("nation"), "c_nationkey").alias("archive"), "c_custkey", text.alias("kind", "text"))
    zips.write_zip(members.select("archive", F.concat("c_custkey", "kind").alias("member"), F.encode("text", "utf-8").alias("data")), path)
    found = zips.read_zip(c.sparkSession, path).where(F.col("member").startswith("1") & F.col("member").endswith("/name.txt"))
    return found.select("member", F.col("data").cast("string").alias("data"), "bytes")


@query("SELECT o_orderstatus AS status, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def replaced_manifest(load):
    """A manifest that was written before is replaced in one step."""
    o = load("orders")
    path = scratch(o.sparkSession, "manifest")
    per = o.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    versions.overwrite(per.where("status = 'F'"), path)
    versions.overwrite(per, path)
    return versions.read(o.sparkSession, path)
