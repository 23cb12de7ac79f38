"""Secret scan with corpus-wide ownership frequency.

Every text is scanned for assignments, access key ids and hex strings, and for other
credential-like candidates. Digests of all values are counted over the corpus by the
repositories and owners that hold them: what several owners hold, or one owner in many
repositories, is a copied example; what one owner alone holds in few of them looks live.
Candidates that look live become spans of kind ``owned``; spans of the three base kinds
always stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_slice, stored
from .spans import digest, overlaps

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "owned")
MIN_ENTROPY = 3.5
#: One owner may hold a live secret in so many repositories, say code and its fork.
MAX_REPOSITORIES = 2
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Longer runs of these characters may be a credential of some other form.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_HEX_MAP = bytes(1 if chr(i) in "0123456789abcdef" else 0 for i in range(256))
_CANDIDATE_MAP = bytes(1 if i < 128 and (chr(i).isalnum() or chr(i) in "+/_=-") else 0 for i in range(256))
_CUES = (b"passw", b"secret", b"token", b"api")


def base_spans(text: str, data: bytes | None = None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value), leftmost and non-overlapping per kind; too short
    matches are dropped without another try."""
    data, found = text.encode() if data is None else data, []
    lower = data.lower()
    if any(cue in lower for cue in _CUES):
        found += [("assign", *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in data:
        found += [("access", *m.span(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    if b"\1" * 32 in data.translate(_HEX_MAP):
        found += [("hex", *m.span(), m[0]) for m in _HEX.finditer(text)]
    return found


def candidates(text: str, data: bytes, base: list) -> list[tuple[str, int, int, str]]:
    """Mixed-case strings with digits and high entropy that no base span touches."""
    if b"\1" * 20 not in data.translate(_CANDIDATE_MAP):
        return []
    taken = [s[:3] for s in base]
    return [("owned", *m.span(), m[0]) for m in _CANDIDATE.finditer(text) if _dense(m[0]) and not overlaps(taken, *m.span())]


def _dense(value: str) -> bool:
    if not (any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value)):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= MIN_ENTROPY


_FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<rank: int, start: long, end: long, value: string>>"
_TYPE = pa.list_(pa.struct([("rank", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))


def _scan(batches):
    for batch, texts in each_slice(batches):
        counts, shas, found = [], [], []
        for text in texts:
            data = text.encode()
            base = base_spans(text, data)
            shas.append(digest([s[:3] for s in base], KINDS))
            counts.append([sum(s[0] == k for s in base) for k in BASE])
            spans = base + candidates(text, data, base)
            found.append([{"rank": KINDS.index(k), "start": a, "end": b, "value": hashlib.blake2b(v.encode(), digest_size=16).hexdigest()} for k, a, b, v in spans])
        cols = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*kept, *cols, pa.array(shas, pa.string()), pa.array(found, _TYPE)], [*batch.schema.names[:-1], "n_assign", "n_access", "n_hex", "base_sha256", "found"])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = 1, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """One row per row: id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied,
    owners, repositories.

    A value is live-looking if at most max_owners owners and max_repositories repositories
    hold it. owners and repositories are those of the row's values, in order of their
    places (of equal ones by kind), base values and candidates alike. Null texts are empty;
    null owners count as one owner, null repositories as one repository each. Repeated rows
    are rows of their own in one repository, an empty table has no rows, and a text of any
    length is scanned whole.
    """
    repository = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x1e")) for c in repository_cols])
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{owner_col}`").cast("string"), F.lit("\x1e")).alias("owner"), repository.alias("repository"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    seen = rows.mapInArrow(_scan, f"id {kind}, owner string, repository string, {_FOUND}").withColumn("row", F.monotonically_increasing_id())
    seen = stored(seen, "secrets")
    values = seen.where(F.size("found") > 0).select("row", "owner", "repository", F.posexplode("found").alias("at", "span"))
    held = values.groupBy(F.col("span.value").alias("value"), "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    held = held.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories")).groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    judged = values.select("row", "at", "span.*").join(held, "value").withColumn("live", (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories))
    per_row = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when((F.col("rank") < 3) | F.col("live"), F.struct("start", "rank", "end")))).alias("spans"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_copied"),
        F.array_sort(F.collect_list(F.struct("start", "rank", "owners", "repositories"))).alias("counts"),
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    out = seen.join(per_row, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(text, F.lit("")).alias("spans"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_live", "n_copied")], *[F.coalesce(F.col(f"counts.{c}"), F.array().cast("array<bigint>")).alias(c) for c in ("owners", "repositories")])
