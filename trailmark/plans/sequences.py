"""Sequence kernels, windows, logs and streams over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailmark.functions import sequences as S
from trailmark.functions.times import micros
from trailmark.operators import scans, simlog, trajectories
from trailmark.session import scratch
from trailmark.streaming import events as streams

from .registry import query


def _order():
    return [F.col("ts").asc(), F.col("event_id").asc()]


def _rows(load, scale=1.0, **more):
    """user_id, ts, event_id, v, i (its place) and n (its user's rows), and more scans."""
    e = load("events").select("user_id", "ts", "event_id", (F.col("value") / scale).alias("v"))
    return scans.running(e, ["user_id"], _order(), {"i": scans.place(), **more}, {"n": F.count(F.lit(1))})


def _near(w, k):
    """The row k places on, in a struct v; null where the user has none."""
    boxed = F.struct("v")
    return boxed if k == 0 else F.lead(boxed, k).over(w) if k > 0 else F.lag(boxed, -k).over(w)


_S = "WITH s AS (SELECT user_id, value AS v, (row_number() OVER w - 1)::INT AS i, (count(*) OVER (PARTITION BY user_id))::INT AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query(f"""{_S}
    SELECT user_id, i, round(CASE WHEN n = 1 THEN 0 WHEN i = 0 THEN lead(v) OVER w - v WHEN i = n - 1 THEN v - lag(v) OVER w ELSE (lead(v) OVER w - lag(v) OVER w) / 2 END / 0.1, 6) AS slope
    FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i)""")
def central_differences(load):
    e = _rows(load, prev=scans.previous(F.col("v")), next=scans.following(F.col("v")))
    has = [F.col(c).isNotNull().cast("int") for c in ("prev", "next")]
    lo, hi = (F.when(h == 1, F.col(c)["v"]).otherwise(F.col("v")) for h, c in zip(has, ("prev", "next"), strict=True))
    slope = F.when(has[0] + has[1] > 0, (hi - lo) / ((has[0] + has[1]) * F.lit(0.1))).otherwise(F.lit(0.0))
    return e.select("user_id", "i", F.round(slope, 6).alias("slope"))


@query(f"""{_S}
    SELECT a.user_id, a.i, round(avg(b.v), 6) AS smooth FROM s a, (VALUES (-2), (-1), (0), (1), (2)) k(d), s b
    WHERE b.user_id = a.user_id AND b.i = greatest(0, least(a.n - 1, a.i + d)) GROUP BY 1, 2""")
def edge_repeating_average(load):
    edge = lambda w, k: F.coalesce(*[_near(w, j) for j in range(k, 0, -1 if k > 0 else 1)], _near(w, 0))["v"]
    smooth = lambda w: sum((edge(w, k) for k in range(-2, 3)), F.lit(0.0)) / 5
    return scans.framed(_rows(load), ["user_id"], "i", 2, 2, {"smooth": smooth}).select("user_id", "i", F.round("smooth", 6).alias("smooth"))


@query(f"""{_S}, r AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS g FROM s WHERE v < 40),
    k AS (SELECT user_id, max(c) AS best FROM (SELECT user_id, g, count(*) AS c FROM r GROUP BY 1, 2) GROUP BY 1)
    SELECT DISTINCT s.user_id, coalesce(best, 0)::INT AS longest FROM s LEFT JOIN k ON s.user_id = k.user_id""")
def longest_runs(load):
    runs = _rows(load, run=scans.total(F.when(F.col("v") < 40, 0).otherwise(1))).groupBy("user_id", "run").agg(F.count_if(F.col("v") < 40).alias("n"))
    return runs.groupBy("user_id").agg(F.max("n").cast("int").alias("longest"))


@query(f"{_S} SELECT user_id, i, round(sum(v) OVER (PARTITION BY user_id ORDER BY i), 6) AS total FROM s")
def running_sums(load):
    return _rows(load, total=scans.total(F.col("v"))).select("user_id", "i", F.round("total", 6).alias("total"))


@query(f"""{_S}, d AS (SELECT user_id, i, v / 20 AS a, v / 20 - lag(v / 20) OVER (PARTITION BY user_id ORDER BY i) AS d FROM s)
    SELECT user_id, i, round(first_value(a) OVER w + coalesce(sum(CASE WHEN abs(d) < pi() THEN d ELSE d - 2 * pi() * floor((d + pi()) / (2 * pi())) END) OVER w, 0), 6) AS angle
    FROM d WINDOW w AS (PARTITION BY user_id ORDER BY i)""")
def unwrapped_angles(load):
    e = _rows(load, scale=20, prev=scans.previous(F.col("v"))).withColumn("step", S.turn_step(F.col("v") - F.col("prev")["v"]))
    turned = scans.running(e, ["user_id"], _order(), {"start": scans.first(F.col("v")), "turned": scans.total(F.col("step"))})
    return turned.select("user_id", "i", F.round(F.col("start") + F.coalesce("turned", F.lit(0.0)), 6).alias("angle"))


@query(f"""{_S}, m AS (SELECT user_id, i, v, v - min(v) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS drop, n FROM s)
    SELECT user_id, i AS start, round(drop, 6) AS drop FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY drop DESC, i) AS k FROM m WHERE i + 8 <= n) WHERE k = 1""")
def sharpest_window(load):
    """The window of eight samples with the largest fall from its first, the earliest such."""
    drop = lambda w: F.col("v") - F.min("v").over(w.rowsBetween(0, 7))
    starts = scans.framed(_rows(load), ["user_id"], "i", 0, 7, {"drop": drop}).where("i + 8 <= n")
    best = starts.groupBy("user_id").agg(F.max(F.struct("drop", (-F.col("i")).alias("neg"))).alias("b"))
    return best.select("user_id", (-F.col("b.neg")).alias("start"), F.round("b.drop", 6).alias("drop"))


@query(f"""{_S} SELECT user_id, (i // 20)::BIGINT AS chunk, count(*) AS n, round(avg(v), 6) AS mean FROM s WHERE i // 20 < n // 20 GROUP BY 1, 2""")
def whole_chunks(load):
    return trajectories.chunks(_rows(load), ["user_id"], "i", 20).groupBy("user_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"))


@query(f"""{_S}, w(j, k, c) AS (VALUES {", ".join(f"({j}, {k}, {c!r}::DOUBLE)" for j, row in enumerate(S.savgol_weights(7, 2, 1, 0.1)) for k, c in enumerate(row))}),
    p AS (SELECT user_id, i, greatest(0, least(i - 3, n - 7)) AS a FROM s WHERE n >= 7)
    SELECT p.user_id, p.i, round(sum(c * s.v), 7) AS rate FROM p JOIN w ON w.j = p.i - a JOIN s ON s.user_id = p.user_id AND s.i = a + k GROUP BY 1, 2""")
def polynomial_rates(load):
    """Savitzky-Golay first derivative, window 7, order 2."""
    near = lambda w: F.array(*[_near(w, k)["v"] for k in range(-6, 7)])
    e = scans.framed(_rows(load).where("n >= 7"), ["user_id"], "i", 6, 6, {"near": near})
    j = (F.col("i") - F.greatest(F.lit(0), F.least(F.col("i") - 3, F.col("n") - 7))).cast("int")
    weights = F.get(F.array(*[F.array(*[F.lit(w) for w in row]) for row in S.savgol_weights(7, 2, 1, 0.1)]), j)
    rate = F.aggregate(F.zip_with(F.slice("near", 7 - j, 7), weights, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return e.select("user_id", "i", F.round(rate, 7).alias("rate"))


@query(f"""{_S}, b AS (SELECT user_id, count(*) AS n, arg_min(v, i) AS first, arg_max(v, i) AS last, min(v) AS low, arg_min(i, (v, i)) AS pos FROM s GROUP BY 1)
    SELECT user_id, ((CASE WHEN first > 1e-6 THEN (first - low) / first ELSE 0 END > 0.3 OR low < 2) AND pos < n - 1 AND first - low > 1e-6 AND coalesce((last - low) / nullif(first - low, 0) >= 0.5, false)) AS dipped FROM b""")
def dip_and_recover(load):
    at, v = F.struct("ts", "event_id"), F.col("value")
    ends = {"first": F.min_by(v, at), "last": F.max_by(v, at), "dip": F.min(F.struct(v.alias("v"), at.alias("at"))), "end": F.max(at)}
    b = load("events").groupBy("user_id").agg(*[c.alias(n) for n, c in ends.items()])
    dipped = S.dipped(F.col("first"), F.col("last"), F.col("dip.v"), F.col("dip.at") < F.col("end"))
    return b.select("user_id", F.coalesce(dipped, F.lit(False)).alias("dipped"))


@query(f"""{_S}, g AS (SELECT DISTINCT user_id, n, unnest(range(0, 9)) / 8.0 * (n - 1) AS q FROM s)
    SELECT g.user_id, round(q, 6) AS q, round(a.v + (q - a.i) * (b.v - a.v), 6) AS v FROM g JOIN s a ON a.user_id = g.user_id AND a.i = floor(q) JOIN s b ON b.user_id = g.user_id AND b.i = least(floor(q) + 1, g.n - 1)""")
def resampled_series(load):
    e = _rows(load, next=scans.following(F.col("v")))
    grid = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda k: k / 8.0 * (F.col("n") - 1))
    e = e.withColumn("q", F.explode(F.filter(grid, lambda q: F.floor(q) == F.col("i"))))
    value = F.when(F.col("next").isNull(), F.col("v")).otherwise(F.col("v") + (F.col("q") - F.col("i")) * (F.col("next")["v"] - F.col("v")))
    return e.select("user_id", F.round("q", 6).alias("q"), F.round(value, 6).alias("v"))


@query("""
    WITH b AS (SELECT user_id, min(epoch_us(ts)) / 1e6 AS lo, max(epoch_us(ts)) / 1e6 AS hi, median(epoch_us(ts)) / 1e6 AS t FROM events GROUP BY 1)
    SELECT user_id, round(CASE WHEN lo + 600000 <= hi - 1000000 THEN greatest(lo + 600000, least(hi - 1000000, t)) END, 3) AS t0 FROM b""")
def clamped_times(load):
    s = micros(F.col("ts"))
    b = load("events").groupBy("user_id").agg((F.min(s) / 1e6).alias("lo"), (F.max(s) / 1e6).alias("hi"), (F.percentile(s, F.lit(0.5)) / 1e6).alias("t"))
    return b.select("user_id", F.round(trajectories.clamp_time(F.col("t"), F.col("lo"), F.col("hi"), 600000, 1000000), 3).alias("t0"))


@query("""
    SELECT event_id, round_even(coalesce(epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY event_id), 0), 6) AS delta FROM events""")
def frame_deltas(load):
    e = load("events").withColumn("t", micros(F.col("ts")) / 1e6)
    return simlog.delta_times(e, ["user_id"], "event_id", "t").select("event_id", "delta")


_ACTORS = "a AS (SELECT o_custkey AS actor, min(o_orderkey % 50) AS created, CASE WHEN count(*) > 12 THEN max(o_orderkey % 50) + 1 END AS destroyed, any_value('vehicle.' || (o_custkey % 3)) AS type_id FROM orders GROUP BY 1)"


def _actors(load):
    n, f = F.count(F.lit(1)), F.col("o_orderkey") % 50
    return load("orders").groupBy(F.col("o_custkey").alias("actor")).agg(F.min(f).alias("created"), F.when(n > 12, F.max(f) + 1).alias("destroyed"), F.concat(F.lit("vehicle."), (F.first("o_custkey") % 3).cast("string")).alias("type_id"))


@query(f"WITH {_ACTORS} SELECT actor, created AS first_frame, coalesce(destroyed - 1, 49) AS last_frame FROM a WHERE type_id = 'vehicle.1'")
def alive_intervals(load):
    return simlog.alive(simlog.actors_like(_actors(load), "vehicle.1"), 49).select("actor", "first_frame", "last_frame")


_STATES = "st AS (SELECT o_custkey AS actor, o_orderkey % 50 AS frame, max(o_totalprice) AS x, max(o_totalprice % 7) AS y, max(o_totalprice % 31) - 15 AS z FROM orders GROUP BY 1, 2)"


def _states(load):
    price = F.col("o_totalprice")
    return load("orders").groupBy(F.col("o_custkey").alias("actor"), (F.col("o_orderkey") % 50).alias("frame")).agg(F.max(price).alias("x"), F.max(price % 7).alias("y"), (F.max(price % 31) - 15).alias("z"))


@query(f"WITH {_STATES}, d AS (SELECT actor, unnest(range(20, 30)) AS frame FROM (SELECT DISTINCT actor FROM st)) SELECT d.actor, d.frame, round(x, 4) AS x FROM d LEFT JOIN st ON st.actor = d.actor AND st.frame = d.frame")
def states_over_frames(load):
    st = _states(load)
    return simlog.states_between(st.select("actor").distinct(), st, 20, 29, ["x"]).select("actor", F.col("frame").cast("long").alias("frame"), F.round("x", 4).alias("x"))


@query(f"WITH {_STATES}, d AS (SELECT actor, unnest(range(10, 15)) AS frame FROM (SELECT DISTINCT actor FROM st)) SELECT d.actor, d.frame, round(x, 4) AS x FROM d LEFT JOIN st ON st.actor = d.actor AND st.frame = d.frame")
def states_of_every_actor(load):
    st = _states(load)
    return simlog.states_between(st.select("actor").distinct(), st, 10, 14, ["x"]).select("actor", F.col("frame").cast("long").alias("frame"), F.round("x", 4).alias("x"))


@query(f"WITH {_STATES} SELECT actor, frame, round(last_value(CASE WHEN y > 3 THEN y END IGNORE NULLS) OVER (PARTITION BY actor ORDER BY frame), 4) AS last_y FROM st")
def last_known_state(load):
    st = _states(load).withColumn("y", F.when(F.col("y") > 3, F.col("y")))
    return simlog.last_known(st, "y").select("actor", "frame", F.round("last_y", 4).alias("last_y"))


@query(f"""WITH {_STATES}, k AS (SELECT * FROM st WHERE z >= -10)
    SELECT p.actor AS a, q.actor AS b, p.frame, round(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2), 4) AS distance FROM k p JOIN k q ON q.actor = p.actor + 1 AND p.frame = q.frame""")
def distances_between_actors(load):
    st = _states(load)
    pairs = st.select(F.col("actor").alias("a"), (F.col("actor") + 1).alias("b")).distinct()
    return simlog.distances(st, pairs).withColumn("distance", F.round("distance", 4))


@query("""
    SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def tumbling_windows(load):
    return streams.tumbling(load("events"), "ts", "6 hours", ["event_type"], "value").withColumn("total", F.round("total", 4)).withColumn("mean", F.round("mean", 6))


@query("""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 8 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
         s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 8 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(load):
    return streams.sessions(load("events"), "ts", "8 hours", ["user_id"])


def _stream(load):
    """The events table, a file or a folder of part files, as a stream of files."""
    table, path = load("events"), load.path("events")
    return streams.stream_table(table.sparkSession, path, table.schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("""
    SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def streamed_windows(load):
    """Daily totals by Structured Streaming over what the source holds."""
    e = _stream(load)
    out = streams.to_end(streams.tumbling(e, "ts", "1 day", ["event_type"], "value"), "complete", scratch(e.sparkSession, "windows"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_once(load):
    """Events delivered twice and counted once, however late: each batch adds to a table
    the events that it doesn't hold yet."""
    e = _stream(load).select("user_id", "event_type", "event_id")
    held, checkpoint = scratch(e.sparkSession, "once"), scratch(e.sparkSession, "once-state")
    streams.append_new(e.unionByName(e), held, checkpoint, ["event_id"])
    return e.sparkSession.read.schema(e.schema).parquet(held).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
