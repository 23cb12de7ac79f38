"""String helpers for reasoning text, logs and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that are brought to their ASCII form, one for one.
PUNCTUATION = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "‘": "'", "’": "'", "“": '"', "”": '"', " ": " "}
# Where a sentence falls into beats.
BEATS = r";|,? then\b|\. "


def normalise(text: Column) -> Column:
    """ASCII punctuation; every character keeps its place."""
    return F.translate(text, "".join(PUNCTUATION), "".join(PUNCTUATION.values()))


def beats(text: Column, delimiter: str = BEATS) -> Column:
    """Trimmed parts between delimiters, blank ones left out."""
    return F.filter(F.transform(F.split(text, delimiter), lambda b: F.trim(b)), lambda b: b != "")


def first_connective(beat: Column, strong: list[str], weak: list[str]) -> Column:
    """The first strong connective, or the first weak one where there is no strong one."""
    pick = lambda words: F.nullif(F.regexp_extract(beat, rf"(?i)(?:^|[^\pL\pN_])({'|'.join(words)})(?:[^\pL\pN_]|$)", 1), F.lit(""))
    return F.lower(F.coalesce(pick(strong), pick(weak)))


def strip_fence(text: Column) -> Column:
    """The inside of a fenced block, or the text."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z0-9]*\s*", ""), r"\s*```$", ""))


def only_integer(text: Column) -> Column:
    """The integer in a text that holds exactly one."""
    found = F.regexp_extract_all(text, F.lit(r"-?[0-9]+"), F.lit(0))
    return F.when(F.size(found) == 1, F.try_element_at(found, F.lit(1)).try_cast("long"))


def nth_number(text: Column, n: int) -> Column:
    """The nth number in a message, from 1."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), F.lit(0)), F.lit(n)).try_cast("double")


def safe_key(text: Column) -> Column:
    """Letters and digits of any script stay, the rest becomes underscores."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "_")


def scene_parts(scene_id: Column) -> tuple[Column, Column]:
    """Clip id and time of ``<clip>_<time>``, parted at the last underscore."""
    return F.regexp_extract(scene_id, r"^(.+)_([0-9]+)$", 1), F.regexp_extract(scene_id, r"^(.+)_([0-9]+)$", 2).try_cast("long")


def glob(column: Column, pattern: str) -> Column:
    """Whole-string match of a shell pattern with * and ?."""
    import re

    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return column.rlike(f"^(?s:{body})$")


def log_time(text: Column, zone: Column) -> Column:
    """UTC time of a log stamp in one of three zones."""
    # Hours west of UTC.
    hours = F.when(zone == "PDT", 7).when(zone == "PST", 8).when(zone == "UTC", 0)
    return F.to_timestamp(text) + F.make_dt_interval(F.lit(0), hours)


def with_placeholders(text: Column, values: list[tuple[str, str]], patterns: list[tuple[str, str]] = ()) -> Column:
    """Concrete values replaced by their placeholders in turn, then patterns: a template."""
    for value, placeholder in values:
        text = F.replace(text, F.lit(value), F.lit(placeholder))
    for pattern, placeholder in patterns:
        text = F.regexp_replace(text, pattern, placeholder)
    return text


# How powers are printed.
POWERS = {"": 1, "²": 2, "³": 3, "⁴": 4}


def polynomial(text: Column, symbol: str) -> Column:
    """Coefficients, of power 0 first, of a printed polynomial of degree 4 at most; of terms
    that share a power the last one counts, and one that is no such term is left out.

    Terms are parted by a sign between white space, a term's coefficient (in parentheses
    where it has an exponent) and its power of the symbol by a dot.
    """
    terms = F.split(F.regexp_replace(F.trim(text), r"\s+([+-])\s*", "\n$1"), "\n")
    halves = F.transform(terms, lambda t: F.split(t, "·"))
    table = F.create_map(*[F.lit(x) for sign, power in POWERS.items() for x in (symbol + sign, power)])
    power = lambda h: F.when(F.size(h) == 1, F.lit(0)).otherwise(F.try_element_at(table, F.trim(h[1])))
    value = lambda h: F.regexp_replace(h[0], r"[()\s]", "").try_cast("double")
    read = F.filter(F.transform(halves, lambda h: F.struct(power(h).alias("power"), value(h).alias("value"))), lambda t: t["value"].isNotNull())
    of = lambda p: F.coalesce(F.try_element_at(F.filter(read, lambda t: t["power"] == p), F.lit(-1))["value"], F.lit(0.0))
    return F.array(*[of(p) for p in range(5)])


def rephrased(text: Column, phrases: dict[str, list[str]], draw: Column) -> Column:
    """Each phrase, in turn, replaced by one of its variants that draw (a text) picks; where
    only its lower case occurs, that by the variant in lower case."""
    for phrase, variants in phrases.items():
        pick = F.conv(F.substring(F.md5(F.concat_ws(":", draw, F.lit(phrase))), 1, 8), 16, 10).cast("long") % len(variants)
        chosen = F.get(F.array(*[F.lit(v) for v in variants]), pick.cast("int"))
        low = F.when(text.contains(phrase.lower()), F.replace(text, F.lit(phrase.lower()), F.lower(chosen))).otherwise(text)
        text = F.when(text.contains(phrase), F.replace(text, F.lit(phrase), chosen)).otherwise(low)
    return text


def blank(text: Column) -> Column:
    """Whether a forced text came to nothing; null did not."""
    return F.coalesce(F.regexp_replace(text, r"\s+", "") == "", F.lit(False))


def degenerate(forced: Column, texts: Column) -> Column:
    """Whether a forced alternative generated nothing: it is there, and its first text is
    missing or blank. Null (nothing was forced) is not degenerate."""
    return forced.isNotNull() & blank(F.coalesce(F.get(texts, F.lit(0)), F.lit("")))
