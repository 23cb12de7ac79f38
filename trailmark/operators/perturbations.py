"""Wrong variants of texts, claims and tracks, and the gate that scores must pass on them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.operators import claims

# Words that are turned into each other.
DIRECTIONS = {"left": "right", "right": "left"}
STATES = {"blocking": "clearing", "clearing": "blocking", "closed": "open", "open": "closed", "red": "green", "green": "red"}
ENTITIES = {"pedestrian": ("cyclist", "cyclists"), "cyclist": ("pedestrian", "pedestrians")}
SPEEDS = {"accelerate": "decelerate", "decelerate": "accelerate"}
SIDEWAYS = ("lane_change", "nudge", "merge", "turn", "enter", "exit")
# Fixed value: what counts as a quantity.
QUANTITY = re.compile(r"\b\d+(?:\.\d+)?\s*(?:m/s|km/h|mph|m\b|meters?\b|s\b|seconds?\b|deg(?:rees)?\b|%)", re.I)
# Least positive score, least drop, slack of component sums, least deviation in metres.
POSITIVE, DROP, SLACK, DEVIATION = 0.7, 0.4, 0.02, 2.0
MOST_WORDS = 2
SIDE = re.compile(r"\b(left|right)\b", re.I)
#: What follows a word that only says what somebody rides.
RIDER = re.compile(r"\s+riders?\b", re.I)

CHANGES = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "original", "changed", "text")]))


def recased(word: str, like: str) -> str:
    """word in the form that gives like back: in capitals, with a capital, or small. Of a
    word of mixed case only the first letter counts."""
    forms = ((str.upper, len(like)), (str.capitalize, 1), (str.lower, 1))
    return next(form(word) for form, n in forms if form(like)[:n] == like[:n])


def nearest(pattern: re.Pattern, text: str, start: int, end: int) -> re.Match | None:
    """The match closest to a span, the first of equally close ones."""
    return min(pattern.finditer(text), key=lambda m: max(start - m.end(), m.start() - end, 0), default=None)


def valid_change(text: str, original: str, changed: str, result: str) -> bool:
    """result is text with one occurrence of original changed, by two words at most."""
    if not original or original == changed or abs(len(changed.split()) - len(original.split())) > MOST_WORDS:
        return False
    return any(text[: m.start()] + changed + text[m.start() + len(original) :] == result for m in re.finditer(f"(?={re.escape(original)})", text))


def _times_ten(quantity: str) -> str:
    number = re.match(r"\d+(?:\.(\d+))?", quantity)
    places = len(number[1] or "")
    return f"{float(number[0]) * 10:.{places}f}" + quantity[number.end() :]


def rule_changes(text: str | None, tables: tuple[dict, ...] | None = None) -> list[dict]:
    """At most one change of each kind (direction, state, entity, quantity), each to the
    first claim it fits; none where the claim's own word isn't the nearest or has no
    opposite."""
    text, (_, entities, states) = text or "", tables or claims._compiled()
    found = claims.parse(text, tables)
    first = lambda fits: next((c for c in found if fits(c)), None)
    picks: list[tuple[str, int, int, str]] = []

    def pick(kind: str, claim: dict | None, pattern: re.Pattern, opposites: dict[str, str]):
        m = nearest(pattern, text, claim["start"], claim["end"]) if claim else None
        if m and m[0].lower() == claim["detail"] and claim["detail"] in opposites:
            picks.append((kind, m.start(), m.end(), recased(opposites[claim["detail"]], m[0])))

    pick("direction", first(lambda c: c["kind"] == "commitment" and c["detail"]), SIDE, DIRECTIONS)
    state = first(lambda c: c["kind"] == "perceptual" and c["detail"])
    pick("state", state, states[state["detail"]] if state else SIDE, STATES)
    seen = first(lambda c: c["kind"] == "perceptual")
    if seen and seen["key"] in ENTITIES and not RIDER.match(text, seen["end"]):
        word = text[seen["start"] : seen["end"]]
        picks.append(("entity", seen["start"], seen["end"], recased(ENTITIES[seen["key"]][word.lower().endswith("s")], word)))
    if m := QUANTITY.search(text):
        picks.append(("quantity", m.start(), m.end(), _times_ten(m[0])))
    out = [{"kind": k, "original": text[a:b], "changed": new, "text": text[:a] + new + text[b:]} for k, a, b, new in picks]
    return [c for c in out if valid_change(text, c["original"], c["changed"], c["text"])]


@F.pandas_udf(CHANGES)
def changes(texts: pd.Series) -> pd.Series:
    tables = claims._compiled()
    return texts.map(lambda t: rule_changes(t, tables))


def _paired(column: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), column)


def wrong_identity(maneuver: Column, direction: Column, profile: Column) -> Column:
    """A commitment that says the opposite: (maneuver, direction, profile); null where it
    has none."""
    other_side, other_speed = _paired(direction, DIRECTIONS), _paired(profile, SPEEDS)
    made = lambda m, d, p: F.struct(m.alias("maneuver"), d.alias("direction"), p.alias("profile"))
    return (
        F.when(other_side.isNotNull(), made(maneuver, other_side, profile))
        .when(other_speed.isNotNull(), made(other_speed, direction, other_speed))
        .when(maneuver.isin(*SIDEWAYS), made(F.lit("keep_lane"), direction, profile))
        .when(maneuver == "keep_lane", made(F.lit("lane_change"), direction, profile))
    )


def reversed_track(track: Column) -> Column:
    return F.reverse(track)


def unreacting_track(track: Column) -> Column:
    """The track as it would be had its first step gone on."""
    first, second = F.get(track, F.lit(0)), F.get(track, F.lit(1))
    step = lambda k: F.coalesce(second[k] - first[k], F.lit(0.0))
    return F.transform(track, lambda _, i: F.array(first[0] + i * step(0), first[1] + i * step(1)))


def deviation(track: Column, other: Column) -> Column:
    """Largest distance between samples of the same place; null for empty tracks."""
    return F.array_max(F.zip_with(track, other, lambda a, b: F.sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2)))


def tells_apart(track: Column, other: Column, least: float = DEVIATION) -> Column:
    """Whether a changed track is another one at all."""
    return F.coalesce(deviation(track, other) >= least, F.lit(False))


def gate(cases: DataFrame, key: str, positive: Column, score: Column, parts: Column | None = None, least: float = POSITIVE, drop: float = DROP) -> DataFrame:
    """key, positive, worst (the best wrong case), failures and passed.

    Scores count within 0 and 1. The positive case must reach ``least``, each wrong one
    stay ``drop`` below it; a missing or NaN score, a score or a sum of parts above 1, and
    parts that don't sum to the score are failures each.
    """
    finite = score.isNotNull() & ~F.isnan(score)
    held = F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) if parts is not None else F.lit(None).cast("double")
    off = F.abs(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)) - held) > SLACK
    rows = cases.select(key, positive.alias("_positive"), held.alias("_score"), (F.coalesce(finite & (score > 1 + 1e-9), F.lit(False)) | F.coalesce(total > 1 + 1e-9, F.lit(False))).alias("_over"), F.coalesce(off, F.lit(False)).alias("_off"))
    out = rows.groupBy(key).agg(
        F.min(F.when(F.col("_positive"), F.col("_score"))).alias("positive"),
        F.max(F.when(~F.col("_positive"), F.col("_score"))).alias("worst"),
        F.count_if(F.col("_score").isNull()).alias("_missing"),
        F.count_if("_over").alias("_over"),
        F.count_if("_off").alias("_off"),
    )
    said = {
        "missing score": F.col("_missing") > 0,
        "positive too low": F.col("positive").isNull() | (F.col("positive") < least),
        "wrong case too high": F.coalesce(F.col("worst") > F.col("positive") - drop, F.lit(False)),
        "over budget": F.col("_over") > 0,
        "parts differ": F.col("_off") > 0,
    }
    failures = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in said.items()]))
    return out.select(key, "positive", "worst", failures.alias("failures")).withColumn("passed", F.size("failures") == 0)
