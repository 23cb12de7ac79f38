"""What was said about a scene, held against its tracks; wrong variants; rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.operators import claims, perception, perturbations, rewards

from .registry import query

# Sentences of orders, part by part from the order's key; the SQL says the same.
_MOVES = (("Turn", "turn"), ("Stop", "stop"), ("Nudge", "nudge"), ("Merge", "merge"), ("Accelerate", "accelerate"), ("Yield", "yield"))
_SIDES = ("left", "right", "")
_LINKS = ("because", "since", "due to", "after")
_THINGS = (("pedestrian", "pedestrian"), ("cyclist", "cyclist"), ("traffic light", "signal"), ("gate", "gate"), ("roundabout", "roundabout"))
_STATES = ("crossing", "ahead", "blocking", "closed", "red", "open")
_EXTRAS = ("", " quite suddenly", " within 3.5 m", " at 20 km/h")
#: Name -> its values, and what the key is divided by before the remainder picks one.
_PARTS = {
    "move": ([m for m, _ in _MOVES], 1), "move_key": ([k for _, k in _MOVES], 1), "side": (_SIDES, 6), "link": (_LINKS, 18),
    "thing": ([t for t, _ in _THINGS], 1), "thing_key": ([k for _, k in _THINGS], 1), "state": (_STATES, 5), "extra": (_EXTRAS, 7),
}
_SAID = "said AS (SELECT *, move || CASE WHEN side = '' THEN '' ELSE ' ' || side END || ' ' || link || ' the ' || thing || ' is ' || state || extra AS text FROM (SELECT o_orderkey, %s FROM orders))" % ", ".join(
    f"{list(values)!r}[(o_orderkey // {by} % {len(values)}) + 1] AS {name}" for name, (values, by) in _PARTS.items()
)


def _said(load):
    """orders with the parts of a sentence each, and the sentence."""
    key = F.col("o_orderkey")
    part = lambda values, by: F.get(F.array(*[F.lit(v) for v in values]), (F.floor(key / by) % len(values)).cast("int"))
    said = load("orders").select("o_orderkey", *[part(values, by).alias(name) for name, (values, by) in _PARTS.items()])
    side = F.when(F.col("side") == "", "").otherwise(F.concat(F.lit(" "), "side"))
    return said.withColumn("text", F.concat("move", side, F.lit(" "), "link", F.lit(" the "), "thing", F.lit(" is "), "state", "extra"))


@query(f"WITH {_SAID} SELECT o_orderkey, move_key || ',' || side || ',effect;' || thing_key || ',' || state || ',cause' AS claims FROM said")
def sentence_claims(load):
    c = _said(load).select("o_orderkey", claims.parsed("text").alias("c"))
    told = F.transform("c", lambda x: F.concat_ws(",", x["key"], F.coalesce(x["detail"], F.lit("")), x["role"]))
    return c.select("o_orderkey", F.array_join(told, ";").alias("claims"))


@query(f"""WITH {_SAID} SELECT o_orderkey, n, round(chars / length(text), 9) AS fraction FROM (
    SELECT *, (side <> '')::INT + (extra <> '')::INT AS n, CASE WHEN side = '' THEN 0 ELSE 7 + length(side) + length(link) END + length(extra) AS chars FROM said)""")
def unparsed_shares(load):
    """What of each sentence no claim covers."""
    c = _said(load).select("o_orderkey", claims.coverage("text").alias("c"))
    return c.select("o_orderkey", F.size("c.unparsed").alias("n"), F.round(claims.unparsed_fraction(F.col("c")), 9).alias("fraction"))


@query(f"""WITH {_SAID} SELECT o_orderkey, upper(link[1]) || link[2:] || ' the ' || thing || ' is ' || state || extra || ', ' || lower(move[1]) || move[2:] || CASE WHEN side = '' THEN '' ELSE ' ' || side END AS text, 1 AS turned FROM said""")
def causes_first(load):
    return _said(load).select("o_orderkey", claims.cause_first(F.col("text")).alias("r")).select("o_orderkey", "r.text", "r.turned")


@query(f"""WITH {_SAID}, c AS (
      SELECT o_orderkey, text, 'direction' AS kind, side AS original, CASE side WHEN 'left' THEN 'right' ELSE 'left' END AS changed FROM said WHERE side <> ''
      UNION ALL SELECT o_orderkey, text, 'state', state, CASE state WHEN 'blocking' THEN 'clearing' WHEN 'closed' THEN 'open' WHEN 'open' THEN 'closed' ELSE 'green' END FROM said WHERE state IN ('blocking', 'closed', 'open', 'red')
      UNION ALL SELECT o_orderkey, text, 'entity', thing, CASE thing WHEN 'cyclist' THEN 'pedestrian' ELSE 'cyclist' END FROM said WHERE thing IN ('cyclist', 'pedestrian')
      UNION ALL SELECT o_orderkey, text, 'quantity', CASE WHEN extra LIKE '%m' THEN '3.5 m' ELSE '20 km/h' END, CASE WHEN extra LIKE '%m' THEN '35.0 m' ELSE '200 km/h' END FROM said WHERE extra LIKE ' within%' OR extra LIKE ' at%')
    SELECT o_orderkey, kind, original, changed, replace(text, original, changed) AS text FROM c""")
def rule_perturbations(load):
    """Each sentence with one claim made wrong at a time."""
    return _said(load).select("o_orderkey", F.explode(perturbations.changes("text")).alias("c")).select("o_orderkey", "c.*")


_CLASS = "CASE l_suppkey % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'rider' WHEN 2 THEN 'automobile' ELSE 'bus' END"
_CLAIMED = [("pedestrian", "crossing"), ("pedestrian", "ahead"), ("pedestrian", None), ("cyclist", "approaching"), ("vehicle_generic", "pulling_away"), ("vehicle_generic", "blocking"), ("cross_traffic", "encroaching"), ("stopped_vehicle", "nearby"), ("workers", None), ("pedestrian", "red"), ("signal", "green"), ("curve", None)]


def _tracks(load):
    seen = F.col("l_suppkey") % 4
    label = F.when(seen == 0, "person").when(seen == 1, "rider").when(seen == 2, "automobile").otherwise("bus")
    x, y = F.col("l_quantity") - 15, F.round(F.col("l_discount") * 100) - 5
    return load("lineitem").select("l_orderkey", "l_partkey", seen.alias("track_id"), label.alias("label_class"), ((F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 10000.0 + F.col("l_quantity") * 100 + F.round(F.col("l_discount") * 100)).alias("ts"), x.cast("double").alias("x"), y.cast("double").alias("y"))


@query(f"""
    WITH r AS (SELECT l_orderkey, l_suppkey % 4 AS track, {_CLASS} AS class, (l_linenumber * 1000000 + l_partkey) * 10000.0 + l_quantity * 100 + round(l_discount * 100) AS ts, (l_quantity - 15)::DOUBLE AS x, (round(l_discount * 100) - 5)::DOUBLE AS y FROM lineitem WHERE l_linenumber BETWEEN 1 AND 6),
      t AS (SELECT l_orderkey, class, avg(x) AS mx, avg(y) AS my, arg_min(y, ts) * arg_max(y, ts) AS sides, arg_max(sqrt(x * x + y * y), ts) - arg_min(sqrt(x * x + y * y), ts) AS gain
            FROM r GROUP BY l_orderkey, track, class HAVING count(*) >= 2 AND min(sqrt(x * x + y * y)) <= 50),
      m(claim, class) AS (VALUES {", ".join(f"('{e}', '{c}')" for e, cs in claims.ENTITY_CLASSES.items() for c in cs)}),
      s AS (SELECT l_orderkey, claim, bool_or(mx > 0) AS ahead, bool_or(sides < 0) AS crossing, bool_or(gain <= -2) AS nearing, bool_or(gain >= 2) AS leaving, bool_or(mx > 0 AND mx <= 40 AND abs(my) <= 1.75) AS corridor FROM t JOIN m USING (class) GROUP BY 1, 2),
      q(claim, detail) AS (VALUES {", ".join(f"('{e}', {repr(d) if d else 'NULL'})" for e, d in _CLAIMED)}),
      j AS (SELECT o.o_orderkey AS l_orderkey, q.claim, q.detail, s.claim IS NOT NULL AS there, q.claim IN (SELECT claim FROM m) AS known,
              CASE q.detail WHEN 'ahead' THEN ahead WHEN 'crossing' THEN crossing WHEN 'approaching' THEN nearing WHEN 'pulling_away' THEN leaving WHEN 'blocking' THEN corridor WHEN 'encroaching' THEN corridor WHEN 'nearby' THEN true END AS holds
            FROM orders o CROSS JOIN q LEFT JOIN s ON s.l_orderkey = o.o_orderkey AND s.claim = q.claim),
      v AS (SELECT *, CASE WHEN NOT known THEN 'ABSTAIN' WHEN there THEN 'PASS' ELSE 'FAIL' END AS existence,
              CASE WHEN detail IS NOT NULL THEN CASE WHEN NOT known OR NOT there OR holds IS NULL THEN 'ABSTAIN' WHEN holds THEN 'PASS' ELSE 'FAIL' END END AS state FROM j)
    SELECT l_orderkey, claim, detail, existence, state, CASE WHEN existence = 'FAIL' OR coalesce(state = 'FAIL', false) THEN 'FAIL'
        WHEN existence = 'PASS' AND coalesce(state = 'PASS', true) AND claim NOT IN ('stopped_vehicle', 'lead_vehicle', 'cutin_vehicle', 'cross_traffic', 'oncoming_traffic', 'workers') THEN 'PASS' ELSE 'ABSTAIN' END AS verdict FROM v""")
def state_verdicts(load):
    """Claims of presence and state for every order, against its tracks."""
    spark = load("orders").sparkSession
    told = spark.createDataFrame(_CLAIMED, "claim string, detail string")
    said = load("orders").select(F.col("o_orderkey").alias("l_orderkey")).join(F.broadcast(told))
    return perception.state_verdicts(said, _tracks(load), "l_orderkey", (F.lit(1e10), F.lit(7e10)))


@query(f"""
    WITH r AS (SELECT l_orderkey, l_suppkey % 4 AS track, CASE l_partkey % 10 WHEN 0 THEN 'ghost' WHEN 9 THEN 'animal' ELSE {_CLASS} END AS class FROM lineitem),
      t AS (SELECT l_orderkey, track, count(*) AS n FROM r WHERE class <> 'ghost' GROUP BY 1, 2 HAVING count(DISTINCT class) = 1)
    SELECT l_orderkey, count(*) AS tracks, sum(n)::BIGINT AS samples FROM t GROUP BY 1""")
def lenient_tracks(load):
    """Tracks left once unknown classes and tracks of several classes are gone."""
    part = F.col("l_partkey") % 10
    tracks = _tracks(load).withColumn("label_class", F.when(part == 0, "ghost").when(part == 9, "animal").otherwise(F.col("label_class")))
    sizes = perception.load_tracks(tracks, "l_orderkey").groupBy("l_orderkey", "track_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("tracks"), F.sum("n").alias("samples"))


@query(f"""
    WITH r AS (SELECT l_orderkey, l_suppkey % 4 AS track, CASE l_partkey % 10 WHEN 0 THEN 'ghost' WHEN 9 THEN 'animal' ELSE {_CLASS} END AS class FROM lineitem)
    SELECT DISTINCT l_orderkey, 'unknown class' AS fault, class AS detail FROM r WHERE class = 'ghost'
    UNION ALL SELECT l_orderkey, 'mixed classes', track::VARCHAR FROM r GROUP BY l_orderkey, track HAVING count(DISTINCT class) > 1""")
def track_faults(load):
    """What strict loading would refuse."""
    part = F.col("l_partkey") % 10
    tracks = _tracks(load).withColumn("label_class", F.when(part == 0, "ghost").when(part == 9, "animal").otherwise(F.col("label_class")))
    return perception.faults(tracks, "l_orderkey")


_IDENTITY = "CASE o_orderkey % 8 WHEN 0 THEN 'lane_change' WHEN 1 THEN 'keep_lane' WHEN 2 THEN 'turn' WHEN 3 THEN 'stop' WHEN 4 THEN 'accelerate' WHEN 5 THEN 'create_gap' WHEN 6 THEN 'exit' ELSE 'proceed' END"


@query(f"""
    WITH c AS (SELECT o_orderkey, {_IDENTITY} AS m, CASE o_custkey % 5 WHEN 0 THEN 'left' WHEN 1 THEN 'right' END AS d, CASE o_custkey % 3 WHEN 0 THEN 'accelerate' WHEN 1 THEN 'decelerate' ELSE 'hold' END AS p FROM orders),
      f AS (SELECT *, d IS NOT NULL AS turns, p <> 'hold' AS speeds, CASE WHEN m IN ('lane_change', 'turn', 'exit') THEN 'keep_lane' WHEN m = 'keep_lane' THEN 'lane_change' END AS other FROM c)
    SELECT o_orderkey, CASE WHEN turns THEN m WHEN speeds THEN CASE p WHEN 'accelerate' THEN 'decelerate' ELSE 'accelerate' END ELSE other END AS maneuver,
      CASE WHEN turns THEN CASE d WHEN 'left' THEN 'right' ELSE 'left' END END AS direction,
      CASE WHEN turns THEN p WHEN speeds THEN CASE p WHEN 'accelerate' THEN 'decelerate' ELSE 'accelerate' END WHEN other IS NOT NULL THEN p END AS profile FROM f""")
def wrong_identities(load):
    """Commitments turned into their opposites."""
    names = ["lane_change", "keep_lane", "turn", "stop", "accelerate", "create_gap", "exit", "proceed"]
    move = F.get(F.array(*[F.lit(n) for n in names]), (F.col("o_orderkey") % 8).cast("int"))
    side = F.when(F.col("o_custkey") % 5 == 0, "left").when(F.col("o_custkey") % 5 == 1, "right")
    pace = F.when(F.col("o_custkey") % 3 == 0, "accelerate").when(F.col("o_custkey") % 3 == 1, "decelerate").otherwise("hold")
    return load("orders").select("o_orderkey", perturbations.wrong_identity(move, side, pace).alias("w")).select("o_orderkey", "w.*")


_ORDER = ("l_linenumber", "l_partkey", "l_quantity", "l_discount")


@query(f"""
    WITH t AS (SELECT l_orderkey, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, l_quantity::DOUBLE AS x, l_tax * 100 AS y FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {", ".join(_ORDER)})),
      f AS (SELECT l_orderkey, arg_min(x, i) AS x0, arg_min(y, i) AS y0, coalesce(max(x) FILTER (i = 1) - arg_min(x, i), 0) AS dx, coalesce(max(y) FILTER (i = 1) - arg_min(y, i), 0) AS dy FROM t GROUP BY 1)
    SELECT l_orderkey, round(max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)), 6) AS turned, round(max(sqrt((a.x - x0 - a.i * dx) ** 2 + (a.y - y0 - a.i * dy) ** 2)), 6) AS unreacting,
      coalesce(max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) >= 2, false) AS turned_counts
    FROM t a JOIN t b USING (l_orderkey) JOIN f USING (l_orderkey) WHERE b.i = a.n - 1 - a.i GROUP BY 1""")
def counterfactual_tracks(load):
    """How far a track lies from itself reversed, and from its first step carried on."""
    point = F.struct(*_ORDER, F.array(F.col("l_quantity").cast("double"), F.col("l_tax") * 100).alias("p"))
    t = load("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(point)).alias("s")).select("l_orderkey", F.transform("s", lambda x: x["p"]).alias("track"))
    track = F.col("track")
    back, on = perturbations.reversed_track(track), perturbations.unreacting_track(track)
    return t.select("l_orderkey", F.round(perturbations.deviation(track, back), 6).alias("turned"), F.round(perturbations.deviation(track, on), 6).alias("unreacting"), perturbations.tells_apart(track, back).alias("turned_counts"))


@query("""
    WITH c AS (SELECT l_orderkey, l_linenumber = 1 AS positive, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_quantity / 45 END AS score, l_quantity / 90 + (l_quantity / 90 + CASE WHEN l_returnflag = 'R' THEN 0.05 ELSE 0 END) AS total FROM lineitem),
      h AS (SELECT *, greatest(0, least(1, score)) + CASE WHEN score IS NULL THEN NULL ELSE 0 END AS held, coalesce(score > 1 + 1e-9, false) OR total > 1 + 1e-9 AS is_over, coalesce(abs(greatest(0, least(1, total)) - greatest(0, least(1, score)) - CASE WHEN score IS NULL THEN NULL ELSE 0 END) > 0.02, false) AS off FROM c),
      g AS (SELECT l_orderkey, min(held) FILTER (positive) AS pos, max(held) FILTER (NOT positive) AS worst, count(*) FILTER (held IS NULL) AS missing, count(*) FILTER (is_over) AS n_over, count(*) FILTER (off) AS n_off FROM h GROUP BY 1),
      f AS (SELECT *, concat_ws(',', CASE WHEN missing > 0 THEN 'missing score' END, CASE WHEN pos IS NULL OR pos < 0.7 THEN 'positive too low' END, CASE WHEN worst > pos - 0.4 THEN 'wrong case too high' END, CASE WHEN n_over > 0 THEN 'over budget' END, CASE WHEN n_off > 0 THEN 'parts differ' END) AS failures FROM g)
    SELECT l_orderkey, round(pos, 9) AS positive, round(worst, 9) AS worst, failures, failures = '' AS passed FROM f""")
def gated_scores(load):
    """Which scenes' scores tell the right case from the wrong ones."""
    q = F.col("l_quantity").cast("double")
    score = F.when(F.col("l_partkey") % 11 != 0, q / 45)
    parts = F.array(q / 90, q / 90 + F.when(F.col("l_returnflag") == "R", 0.05).otherwise(0.0))
    out = perturbations.gate(load("lineitem"), "l_orderkey", F.col("l_linenumber") == 1, score, parts)
    return out.select("l_orderkey", F.round("positive", 9).alias("positive"), F.round("worst", 9).alias("worst"), F.array_join("failures", ",").alias("failures"), "passed")


@query("""
    WITH e AS (SELECT event_id, value / 20 AS d, (user_id % 10) / 10 AS c, -(event_id % 100) / 100 AS r, event_type <> 'error' AS said FROM events),
      p AS (SELECT *, -0.5 * (d / 3.0) + 0.2 * c + 0.3 * (1 - r / -0.4) AS pass, -1 + 0.25 * (CASE WHEN d > 0 THEN least(1, 3.0 / d) ELSE 1 END + least(1, greatest(0, (r + 1) / 0.6))) AS fail,
        (1 / (1 + exp(-(r + 0.4) / 0.05))) * (1 / (1 + exp((d - 3.0) / 0.15))) AS g FROM e)
    SELECT event_id, round(CASE WHEN said THEN g * pass + (1 - g) * fail ELSE -1 END, 7) AS reward FROM p""")
def mixed_rewards(load):
    """Distance, comfort and reasoning in one reward, with a soft gate over the failure band."""
    reasoning = -(F.col("event_id") % 100) / 100
    out = rewards.mixed_reward(F.col("value") / 20, F.col("user_id") % 10 / 10, reasoning, F.col("event_type") != "error", 3.0, -0.4, (0.5, 0.2, 0.3))
    return load("events").select("event_id", F.round(out, 7).alias("reward"))


@query("""
    WITH e AS (SELECT event_id, CASE WHEN event_type <> 'view' THEN value / 200 END AS r, (event_id % 5) / 4 AS share, (event_id % 3) / 10 AS u FROM events)
    SELECT event_id, round(CASE WHEN r IS NULL THEN greatest(0, 0.6 - 0.1 * u) ELSE share * r + (1 - share) * 0.6 END - 1, 9) AS score FROM e""")
def covered_scores(load):
    """Rewards as far as they are covered by decided claims."""
    reward = F.when(F.col("event_type") != "view", F.col("value") / 200)
    return load("events").select("event_id", F.round(rewards.covered(reward, F.col("event_id") % 5 / 4, F.col("event_id") % 3 / 10, F.lit(0.6)), 9).alias("score"))


@query(f"""WITH {_SAID}, u AS (SELECT o_orderkey, (CASE WHEN side = '' THEN 0 ELSE 7 + length(side) + length(link) END + length(extra)) / length(text) AS u FROM said),
      v AS (SELECT l_orderkey AS o_orderkey, count(*) FILTER (l_returnflag = 'A') AS ap, count(*) FILTER (l_returnflag = 'R') AS af, count(*) FILTER (l_linestatus = 'F') AS cp, count(*) FILTER (l_linestatus = 'O') AS cf FROM lineitem GROUP BY 1),
      p AS (SELECT o_orderkey, u, ap / nullif(ap + af, 0) AS a, cp / nullif(cp + cf, 0) AS c FROM u LEFT JOIN v USING (o_orderkey))
    SELECT o_orderkey, round(CASE WHEN a IS NOT NULL OR c IS NOT NULL THEN greatest(0, (coalesce(0.7 * a, 0) + coalesce(0.3 * c, 0)) / ((a IS NOT NULL)::INT * 0.7 + (c IS NOT NULL)::INT * 0.3) - 0.1 * u) END, 9) AS reward FROM p""")
def reasoning_rewards(load):
    """Precision of verdicts less the penalty for what the parser left over."""
    u = _said(load).select("o_orderkey", claims.unparsed_fraction(claims.coverage("text")).alias("u"))
    flag, mode = F.col("l_returnflag"), F.col("l_linestatus")
    v = load("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*[F.count_if(c).alias(n) for n, c in {"ap": flag == "A", "af": flag == "R", "cp": mode == "F", "cf": mode == "O"}.items()])
    j = u.join(v, "o_orderkey", "left")
    return j.select("o_orderkey", F.round(rewards.trace_reward(rewards.precision(F.col("ap"), F.col("af")), rewards.precision(F.col("cp"), F.col("cf")), F.col("u")), 9).alias("reward"))
