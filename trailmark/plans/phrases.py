"""Templates, variants of phrases, printed polynomials, and what labels are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions import text as words
from trailmark.operators import labels, sampling

from .registry import query


@query("""
    WITH t AS (SELECT regexp_replace(replace(replace('the ' || CASE o_orderstatus WHEN 'F' THEN 'red car' WHEN 'O' THEN 'van' ELSE 'bus' END || ' on the left in ' || (o_orderkey % 90) || ' m', 'red car', '<OBJECT>'), 'on the left', '<LOCATION>'), 'in [0-9]+ m', 'in <DISTANCE>') AS template FROM orders)
    SELECT template, count(*) AS n FROM t GROUP BY 1""")
def question_templates(load):
    """Distinct templates of sentences once objects, places and distances are placeholders."""
    thing = F.when(F.col("o_orderstatus") == "F", "red car").when(F.col("o_orderstatus") == "O", "van").otherwise("bus")
    said = F.concat(F.lit("the "), thing, F.lit(" on the left in "), (F.col("o_orderkey") % 90).cast("string"), F.lit(" m"))
    template = words.with_placeholders(said, [("red car", "<OBJECT>"), ("on the left", "<LOCATION>")], [(r"in \d+ m", "in <DISTANCE>")])
    return load("orders").groupBy(template.alias("template")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, (p_size / 4)::DOUBLE AS c0, (p_partkey % 97)::DOUBLE AS c1, -(p_size * 1.5)::DOUBLE AS c2, 0.0::DOUBLE AS c3, (p_partkey % 11 + 1) * 1e-8 AS c4 FROM part")
def polynomial_coefficients(load):
    """Coefficients of polynomials as numpy prints them."""
    number = lambda c: c.cast("double").cast("decimal(20,4)").cast("string")
    printed = F.concat(number(F.col("p_size") / 4), F.lit(" + "), number(F.col("p_partkey") % 97), F.lit("·th - "), number(F.col("p_size") * 1.5), F.lit("·th² +\n("), (F.col("p_partkey") % 11 + 1).cast("string"), F.lit("e-08)·th⁴"))
    c = load("part").select("p_partkey", words.polynomial(printed, "th").alias("c"))
    return c.select("p_partkey", *[F.col("c")[k].alias(f"c{k}") for k in range(5)])


_CHOSEN = "[{variants}][('0x' || substr(md5(o_orderkey || '-' || copy || ':{phrase}'), 1, 8))::BIGINT % {n} + 1]"
_STOP, _SLOW = ["Halt", "Come to a halt", "Stand"], ["ease off", "brake gently"]


@query(f"""
    WITH s AS (SELECT o_orderkey, unnest(range(0, 3)) AS copy, CASE WHEN o_orderkey % 2 = 0 THEN 'Stop now and slow down' ELSE 'slow down, then stop' END AS said FROM orders),
      c AS (SELECT *, {_CHOSEN.format(variants=str(_STOP)[1:-1], phrase="Stop", n=len(_STOP))} AS a, {_CHOSEN.format(variants=str(_SLOW)[1:-1], phrase="slow down", n=len(_SLOW))} AS b FROM s)
    SELECT o_orderkey, copy::INT AS copy, replace(CASE WHEN contains(said, 'Stop') THEN replace(said, 'Stop', a) ELSE replace(said, 'stop', lower(a)) END, 'slow down', b) AS said FROM c""")
def phrase_variants(load):
    """Three rewordings of each sentence, the same ones in every run."""
    said = F.when(F.col("o_orderkey") % 2 == 0, "Stop now and slow down").otherwise("slow down, then stop")
    copies = load("orders").select("o_orderkey", said.alias("said"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("copy"))
    draw = F.concat_ws("-", F.col("o_orderkey").cast("string"), F.col("copy").cast("string"))
    return copies.select("o_orderkey", "copy", words.rephrased(F.col("said"), {"Stop": _STOP, "slow down": _SLOW}, draw).alias("said"))


@query("""
    SELECT l_orderkey, count(*) >= 2 AND arg_min(l_quantity, (l_linenumber, l_partkey, l_quantity)) >= arg_max(l_quantity, (l_linenumber, l_partkey, l_quantity)) AND NOT bool_or(l_returnflag = 'R') AS complete FROM lineitem GROUP BY 1""")
def complete_routes(load):
    at = F.struct("l_linenumber", "l_partkey", "l_quantity")
    ends = F.when(F.count(F.lit(1)) >= 2, F.array(F.min_by("l_quantity", at), F.max_by("l_quantity", at))).otherwise(F.array())
    r = load("lineitem").groupBy("l_orderkey").agg(ends.alias("progress"), F.collect_set("l_returnflag").alias("statuses"))
    return r.select("l_orderkey", labels.complete(F.col("progress"), F.col("statuses"), ("R",)).alias("complete"))


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, NOT (l_partkey % 4 = 0 AND l_suppkey % 3 <> 0) AND l_quantity - 10 >= -1.5 AND NOT ((l_partkey % 5 <> 0 AND l_suppkey % 2 = 0 AND l_quantity < 15) OR (l_partkey % 5 = 0 AND l_quantity < 10)) AS counts,
      (l_quantity > 5 AND l_quantity < 40 AND l_tax * 100 > 1.5 AND l_tax * 100 < 6.5) OR (l_quantity / 2 > 5 AND l_quantity / 2 < 40 AND l_tax * 50 > 1.5 AND l_tax * 50 < 6.5) AS visible FROM lineitem""")
def relevant_vehicles(load):
    """Which items, taken for vehicles, count and which are in the image."""
    q, t = F.col("l_quantity").cast("double"), F.col("l_tax").cast("double")
    v = {
        "lane_type": F.when(F.col("l_partkey") % 4 == 0, "Parking").otherwise("Driving"),
        "cuts_in": F.col("l_suppkey") % 3 == 0,
        "ahead": q - 10,
        "base_type": F.when(F.col("l_suppkey") % 2 == 0, "car").otherwise("bicycle"),
        "points": q,
        "role": F.when(F.col("l_partkey") % 5 == 0, "scenario 1").otherwise("other"),
    }
    points = F.array(F.array(q, t * 100), F.array(q / 2, t * 50))
    return load("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", labels.counts(v).alias("counts"), labels.visible(points, (5.0, 1.5), (40.0, 6.5)).alias("visible"))


@query("""
    WITH o AS (SELECT c_custkey, unnest(['a', 'a', 'b']) AS kind, unnest(['1', '2', '3']) AS option FROM customer),
      r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY md5('option:' || c_custkey || kind || option), option) AS k FROM o)
    SELECT c_custkey, kind, option FROM r WHERE k = 1""")
def picked_options(load):
    """One of each customer's nested options, by hash."""
    nested = F.create_map(F.lit("a"), F.array(F.lit("1"), F.lit("2")), F.lit("b"), F.array(F.lit("3")))
    flat = load("customer").select("c_custkey", F.explode(nested).alias("kind", "options")).select("c_custkey", "kind", F.explode("options").alias("option"))
    order = F.md5(F.concat(F.lit("option:"), F.col("c_custkey").cast("string"), "kind", "option"))
    return sampling.first_per_key(flat, ["c_custkey"], [order, F.col("option")])


@query("SELECT l_orderkey, sum(l_quantity) AS q, 2 AS fields FROM lineitem GROUP BY 1")
def trimmed_items(load):
    """Nested items less the fields that a page doesn't show."""
    item = F.struct("l_quantity", "l_tax", "l_discount", "l_partkey")
    t = load("lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))
    t = t.withColumn("items", F.transform("items", lambda x: x.dropFields("l_discount", "l_partkey")))
    fields = len(t.schema["items"].dataType.elementType.fields)
    return t.select("l_orderkey", F.aggregate("items", F.lit(0.0), lambda s, x: s + x["l_quantity"]).alias("q"), F.lit(fields).alias("fields"))


@query("SELECT o_orderkey AS gt_orderkey, o_custkey AS gt_custkey, o_totalprice AS model_price, o_orderstatus AS model_status FROM orders")
def prefixed_fields(load):
    """Two structs as one flat row, each field named after its struct."""
    nested = load("orders").select(F.struct(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("custkey")).alias("gt"), F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status")).alias("model"))
    return nested.select(*[F.col(f"{s.name}.{f.name}").alias(f"{s.name}_{f.name}") for s in nested.schema for f in s.dataType.fields])


@query("SELECT (e.vec_id % 6)::INT AS layer, round(avg((e.label = v.label)::INT), 9) AS agreement FROM embeddings e JOIN embeddings v ON v.vec_id = e.vec_id + 1 GROUP BY 1")
def agreement_by_layer(load):
    """How often a step and the next one name the same label."""
    e = load("embeddings").select("vec_id", "label")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("next"))
    return e.join(after, "vec_id").groupBy((F.col("vec_id") % 6).cast("int").alias("layer")).agg(F.round(F.avg((F.col("label") == F.col("next")).cast("int")), 9).alias("agreement"))
