"""Distributions, token ids, poses and paths, and samples that balance classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions import geometry, statistics
from trailmark.functions import sequences as S
from trailmark.operators import boxes, pursuit, sampling

from .registry import query

_STEPS = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: 8 * x::DOUBLE) AS l FROM embeddings),
      r AS (SELECT *, list_max(l) AS top, list_transform(l, lambda x: exp(x - list_max(l))) AS raised FROM e),
      q AS (SELECT vec_id, label, l, top, list_sum(raised) AS total, list_transform(raised, lambda x: x / list_sum(raised)) AS p FROM r),
      s AS (SELECT vec_id, label, -list_sum(list_transform(p, lambda x: x * ln(greatest(x, 1e-12)))) AS entropy, list_reverse_sort(p)[2] AS runner_up, list_position(p, list_max(p)) - 1 AS best, ln(total) + top - l[vec_id % len(l) + 1] AS nll FROM q)"""


def _steps(load):
    logits = F.transform("embedding", lambda x: x.cast("double") * 8)
    e = load("embeddings").select("vec_id", "label", logits.alias("l")).withColumn("p", statistics.softmax(F.col("l")))
    two = statistics.largest(F.col("p"), 2)
    nll = statistics.negative_log_likelihood(F.col("l"), (F.col("vec_id") % F.size("l")).cast("int"))
    return e.select("vec_id", "label", statistics.entropy(F.col("p")).alias("entropy"), two[1]["value"].alias("runner_up"), two[0]["position"].cast("long").alias("best"), nll.alias("nll"))


@query(f"WITH {_STEPS} SELECT vec_id, round(entropy, 7) AS entropy, round(runner_up, 7) AS runner_up, best::BIGINT AS best, round(nll, 6) AS nll FROM s")
def step_entropies(load):
    """Softmax over each vector: entropy, runner-up, most likely place, likelihood of one."""
    return _steps(load).select("vec_id", F.round("entropy", 7).alias("entropy"), F.round("runner_up", 7).alias("runner_up"), "best", F.round("nll", 6).alias("nll"))


@query(f"""WITH {_STEPS}, k AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round(entropy, 7) DESC, vec_id) AS e, row_number() OVER (PARTITION BY label ORDER BY round(runner_up, 7) DESC, vec_id) AS g FROM s)
    SELECT label, 'entropy' AS method, vec_id, e AS rank FROM k WHERE e <= 5 UNION ALL SELECT label, 'prob_gap', vec_id, g FROM k WHERE g <= 5""")
def uncertain_positions(load):
    """The most uncertain steps of each label, by entropy and by the runner-up's chance."""
    s = _steps(load)
    by = F.array(*[F.struct(F.lit(method).alias("method"), F.round(column, 7).alias("score")) for method, column in (("entropy", "entropy"), ("prob_gap", "runner_up"))])
    scored = s.select("label", "vec_id", F.inline(by))  # both scores from one pass over the vectors
    return sampling.top_per_group(scored, ["label", "method"], [F.desc("score"), F.col("vec_id")], 5).select("label", "method", "vec_id", "rank")


_ORDER = "l_linenumber, l_partkey, l_quantity, l_discount"


def _lists(load, **columns):
    item = F.struct(*_ORDER.split(", "), *[c.alias(n) for n, c in columns.items()])
    t = load("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("s"))
    part = lambda n: F.transform("s", lambda x: x[n]).alias(n)
    return t.select("l_orderkey", *map(part, columns))


@query(f"""
    WITH t AS (SELECT l_orderkey, list(l_partkey % 100 ORDER BY {_ORDER}) AS said, list(l_suppkey % 50 ORDER BY {_ORDER}) AS moves FROM lineitem GROUP BY 1)
    SELECT l_orderkey, array_to_string(list_concat([900], said, [901, 902], list_transform(moves, lambda x: x + 1000), [903]), ' ') AS ids FROM t""")
def completion_ids(load):
    t = _lists(load, said=F.col("l_partkey") % 100, moves=F.col("l_suppkey") % 50)
    ids = S.assembled(900, F.col("said"), [901, 902], F.col("moves"), 903, 1000)
    return t.select("l_orderkey", F.array_join(F.transform(ids, lambda x: x.cast("string")), " ").alias("ids"))


@query(f"""
    WITH t AS (SELECT l_orderkey, l_suppkey % 5 AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS i FROM lineitem), e AS (SELECT l_orderkey, min(i) FILTER (id = 4) AS at_end FROM t GROUP BY 1)
    SELECT l_orderkey, count(*) FILTER (id >= 1 AND id < 3 AND (at_end IS NULL OR i < at_end)) AS tokens, any_value(at_end IS NOT NULL) AS ended FROM t JOIN e USING (l_orderkey) GROUP BY 1""")
def tokens_before_end(load):
    tokens, ended = S.tokens_before(F.col("ids"), 4, 1, 2)
    return _lists(load, ids=(F.col("l_suppkey") % 5).cast("long")).select("l_orderkey", tokens.cast("long").alias("tokens"), ended.alias("ended"))


@query(f"""
    WITH t AS (SELECT l_orderkey, l_quantity::DOUBLE AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS i FROM lineitem),
      d AS (SELECT *, coalesce(round_even((x - lag(x) OVER (PARTITION BY l_orderkey ORDER BY i)) / (2 * pi()), 0), 0) AS turns FROM t)
    SELECT l_orderkey, i::INT AS i, round(x - 2 * pi() * sum(turns) OVER (PARTITION BY l_orderkey ORDER BY i), 6) AS angle FROM d""")
def half_turn_angles(load):
    """Angles without jumps, by whole turns."""
    t = _lists(load, x=F.col("l_quantity").cast("double"))
    out = t.select("l_orderkey", F.posexplode(S.half_turn_unwrap(F.col("x"))).alias("i", "angle"))
    return out.select("l_orderkey", (F.col("i") + 1).alias("i"), F.round("angle", 6).alias("angle"))


@query(f"""
    WITH t AS (SELECT l_orderkey, (l_discount - 0.05) / 3 AS a, l_tax / 7 AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS i FROM lineitem),
      v AS (SELECT *, 5 + sum(a * 0.1) OVER w AS v FROM t WINDOW w AS (PARTITION BY l_orderkey ORDER BY i)), u AS (SELECT *, v - a * 0.1 AS before FROM v),
      h AS (SELECT *, sum(k * before * 0.1 + k * a * 0.005) OVER (PARTITION BY l_orderkey ORDER BY i) AS heading FROM u), g AS (SELECT *, coalesce(lag(heading) OVER (PARTITION BY l_orderkey ORDER BY i), 0) AS was FROM h)
    SELECT l_orderkey, round(sum((before * cos(was) + v * cos(heading)) * 0.05), 7) AS x, round(sum((before * sin(was) + v * sin(heading)) * 0.05), 7) AS y, round(arg_max(heading, i), 7) AS heading, round(arg_max(v, i), 7) AS speed FROM g GROUP BY 1""")
def unicycle_ends(load):
    """Where each order's accelerations and curvatures lead."""
    t = _lists(load, a=(F.col("l_discount") - 0.05) / 3, k=F.col("l_tax") / 7)
    end = F.element_at(geometry.unicycle_path(F.col("a"), F.col("k"), F.lit(5.0), 0.1), -1)
    return t.select("l_orderkey", *[F.round(end[c], 7).alias(c) for c in ("x", "y", "heading", "speed")])


@query("""
    WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity - 25) / 10 AS x, l_tax * 50 - 2 AS y, l_linenumber - 2.0 AS z FROM lineitem),
      a AS (SELECT *, sqrt(x * x + y * y) AS o, atan2(sqrt(x * x + y * y), z) AS t FROM p), u AS (SELECT *, (300 * t + 20 * t ** 2 - 5 * t ** 3) / (o + 1e-8) AS s FROM a)
    SELECT l_orderkey, l_linenumber, l_partkey, round(640 + x * s, 5) AS u, round(360 + y * s, 5) AS v, z > 0 AND 640 + x * s >= 0 AND 640 + x * s < 1280 AND 360 + y * s >= 0 AND 360 + y * s < 720 AS valid FROM u""")
def fisheye_pixels(load):
    z = F.col("l_linenumber") - F.lit(2.0)
    u, v, valid = geometry.fisheye_pixel(((F.col("l_quantity") - 25) / 10, F.col("l_tax") * 50 - 2, z), (0.0, 300.0, 20.0, -5.0), (640.0, 360.0), (1280, 720))
    return load("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(u, 5).alias("u"), F.round(v, 5).alias("v"), valid.alias("valid"))


@query("""
    SELECT p_partkey, round(cos(p_size / 10) * (p_size - 3) + sin(p_size / 10) * (p_retailprice / 100 - 5), 6) AS ahead, round(cos(p_size / 10) * (p_retailprice / 100 - 5) - sin(p_size / 10) * (p_size - 3), 6) AS aside FROM part""")
def local_points(load):
    """Points as seen from a pose."""
    point = F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double") / 100)
    seen = F.get(geometry.local_frame(F.array(point), F.array(F.lit(3.0), F.lit(5.0)), F.col("p_size") / 10), F.lit(0))
    return load("part").select("p_partkey", F.round(seen[0], 6).alias("ahead"), F.round(seen[1], 6).alias("aside"))


_UNIT = "(('0x' || substr(md5('{seed}:' || o_orderkey), 1, 12))::BIGINT + 0.5) / 281474976710656.0"


@query(f"""
    WITH p AS (SELECT o_orderkey, o_orderpriority FROM orders WHERE {_UNIT.format(seed="balance-thin")} < CASE o_orderpriority WHEN '1-URGENT' THEN 0.01 ELSE 1 END),
      x AS (SELECT *, 4000.0 / count(*) OVER (PARTITION BY o_orderpriority) AS x FROM p),
      t AS (SELECT o_orderkey, o_orderpriority, least(3, (floor(x) + ({_UNIT.format(seed="balance")} < x - floor(x))::INT)::BIGINT) AS times FROM x)
    SELECT * FROM t WHERE times > 0""")
def rebalanced_classes(load):
    """About as many rows of each priority, one of them thinned to a hundredth first."""
    return sampling.rebalanced(load("orders"), "o_orderkey", "o_orderpriority", 4000, 3, {"1-URGENT": 0.01})


@query("""
    WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank, count(*) OVER () AS n FROM orders),
      p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY rank) AS k FROM r WHERE rank < 8 OR rank = n // 2 OR rank = n - 1)
    SELECT o_orderkey, o_custkey, rank FROM p WHERE k = 1""")
def spread_of_an_order(load):
    """The dearest orders, the middle one and the cheapest, a customer once."""
    return sampling.spread(load("orders"), "o_custkey", "o_totalprice", "o_orderkey", 10).select("o_orderkey", "o_custkey", "rank")


@query("""
    WITH t AS (SELECT unnest(range(0, 6)) / 5.0 AS least), m AS (SELECT o_orderkey, o_orderstatus, (o_totalprice % 1000) / 1000 AS v FROM orders)
    SELECT round(least, 3) AS least, o_orderstatus, count(*) FILTER (v >= least) AS passing, round(avg((v >= least)::INT), 9) AS share FROM m, t GROUP BY 1, 2""")
def threshold_sensitivity(load):
    """How many orders of a status pass each of a range of thresholds, in one pass."""
    v = F.col("o_totalprice") % 1000 / 1000
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: k / 5.0)).alias("least")
    m = load("orders").select("o_orderstatus", v.alias("v"), grid)
    passes = F.col("v") >= F.col("least")
    return m.groupBy(F.round("least", 3).alias("least"), "o_orderstatus").agg(F.count_if(passes).alias("passing"), F.round(F.avg(passes.cast("int")), 9).alias("share"))


@query("""
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    a AS (SELECT vec_id AS atom, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM e WHERE vec_id % 20 = 0),
    s AS (SELECT e.vec_id, atom, list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * u[i])) AS c, list_sum(list_transform(v, lambda x: x * x)) AS square FROM e, a)
    SELECT vec_id, atom, round(c, 6) AS coefficient, round(c * c / square, 6) AS explained FROM s
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, atom) = 1""")
def pursuit_first_atoms(load):
    """Every embedding on its best atom, the atoms being the rows with vec_id % 20 = 0."""
    e = load("embeddings")
    atoms = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("atom"), "embedding")
    found = pursuit.gradient_pursuit(e, atoms, 1, "vec_id", "embedding", "atom")
    return found.select("vec_id", F.get("atoms", F.lit(0)).alias("atom"), F.round(F.get("coefficients", F.lit(0)), 6).alias("coefficient"), F.round("explained", 6).alias("explained"))


@query()
def gradient_pursuit(load):
    """Every embedding as a non-negative sum of at most four atoms; held against a plain loop
    in tests."""
    e = load("embeddings")
    atoms = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("atom"), "embedding")
    return pursuit.gradient_pursuit(e, atoms, 4, "vec_id", "embedding", "atom")


_RETURNED = "p AS (SELECT o.* FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R'))"


def _redrawn(load, stratum, n):
    returned = load("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return sampling.redrawn(load("orders").select("o_orderkey", stratum), [stratum], "o_orderkey", n, lambda c: c.join(returned, "o_orderkey", "left_semi"))


@query(f"""WITH {_RETURNED} SELECT o_orderkey, o_orderpriority, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('redraw:' || o_orderkey), o_orderkey) AS rank FROM p) WHERE rank <= 50""")
def redrawn_quota(load):
    """Fifty orders with a returned line of each priority; others are drawn again."""
    return _redrawn(load, "o_orderpriority", 50)


@query(f"""WITH {_RETURNED}, d AS (SELECT o_custkey, count(*) AS n FROM p GROUP BY 1)
    SELECT o_custkey, coalesce(d.n, 0)::BIGINT AS drawn, (4 - coalesce(d.n, 0))::BIGINT AS short FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN d USING (o_custkey) WHERE coalesce(d.n, 0) < 4""")
def redraw_shortfalls(load):
    """Customers of whom four such orders can't be drawn."""
    return sampling.unmet(load("orders"), _redrawn(load, "o_custkey", 4), ["o_custkey"], 4)


_REACH = " + ".join(f"abs(cos({b}.yaw - t) * {b}.length / 2) + abs(sin({b}.yaw - t) * {b}.width / 2)" for b in "pq")


@query(f"""WITH b AS (SELECT l_suppkey % 20 AS scene, l_orderkey * 8 + l_linenumber AS box, l_partkey % 97 * 2.5 AS x, l_extendedprice % 89 * 2.5 AS y, l_quantity % 3 AS z, 2 + l_quantity / 8 AS length, 1 + l_discount * 20 AS width, 1.5 AS height, l_orderkey % 7 * 0.9 AS yaw FROM lineitem WHERE l_returnflag = 'R'),
    pairs AS (SELECT scene, p, q FROM (SELECT scene, b AS p FROM b) JOIN (SELECT scene, b AS q FROM b) USING (scene) WHERE p.box < q.box AND abs(p.z - q.z) <= 1.5 AND abs(p.x - q.x) < 12 AND abs(p.y - q.y) < 12),
    axes AS (SELECT *, unnest([p.yaw, p.yaw + pi() / 2, q.yaw, q.yaw + pi() / 2]) AS t FROM pairs)
    SELECT scene, p.box AS box_a, q.box AS box_b FROM axes GROUP BY 1, 2, 3 HAVING bool_and(abs((q.x - p.x) * cos(t) + (q.y - p.y) * sin(t)) <= {_REACH})""")
def touching_boxes(load):
    """Pairs of boxes of a scene that intersect, by grids of cells."""
    fields = {
        "x": F.col("l_partkey") % 97 * 2.5, "y": F.col("l_extendedprice") % 89 * 2.5, "z": F.col("l_quantity") % 3, "length": 2 + F.col("l_quantity") / 8,
        "width": 1 + F.col("l_discount") * 20, "height": F.lit(1.5), "yaw": F.col("l_orderkey") % 7 * 0.9,
    }
    b = load("lineitem").where("l_returnflag = 'R'").select((F.col("l_suppkey") % 20).alias("scene"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("box"), *[c.alias(n) for n, c in fields.items()])
    return boxes.touching(b, ["scene"], "box", cell=12.0, within=12.0)
