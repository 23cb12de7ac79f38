"""WARC archives: a writer on Spark's text sink, and a Python data source that reads them.

The source plans file partitions, takes over filters on record type and headers, parses
headers first and seeks past the payloads of records that it doesn't want. Archives of
gzip members are read as they stream by: unwanted payloads are unzipped in pieces, but
neither kept nor decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull

from .common import scratch, stored, text_or_empty
from .files import listing, opened

#: Equal payloads of at least so many bytes are written once.
REVISIT_BYTES = 100
#: Files are packed into partitions of about so many bytes.
PARTITION_BYTES = 64 << 20
RECORDS_PER_FILE = 50_000
#: Repeated digests (about 100 bytes each) are sent to all executors up to this number.
MAX_BROADCAST = 200_000
#: Archives carry a fixed date: equal tables give equal archives.
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Column -> header, where they differ from each other in more than case and dashes.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
    "payload_length": "x-payload-length",
}
SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, payload_length long, content_length long, headers map<string,string>, payload binary"


# ---- writing


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_BYTES, gzip: bool = False) -> None:
    """Writes one record per row. Of equal payloads of at least ``least`` bytes the one
    with the smallest id is a response and the others revisit it; null html is empty.

    Only digests that occur twice or more are joined: sent to all executors while they
    are few, else in a shuffled join whose hot digests adaptive execution splits. Repeated
    rows with the smallest id are all responses. An empty table gives an archive without
    records; a page of any length is one record. gzip compresses each file.
    """
    payload, url = text_or_empty(f"`{html_col}`"), F.coalesce(F.regexp_replace(F.col(f"`{url_col}`").cast("string"), r"[\r\n]+", " "), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{id_col}`").alias("key"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload"))
    firsts = pages.select(F.col(f"`{id_col}`").alias("key"), payload.alias("payload")).where(F.octet_length("payload") >= least)
    firsts = firsts.groupBy(F.sha2("payload", 256).alias("digest")).agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    firsts = stored(firsts, "warc-firsts")
    if firsts.count() <= MAX_BROADCAST:  # else both sides are shuffled, payloads too
        firsts = F.broadcast(firsts)
    marked = rows.join(firsts, "digest", "left").withColumn("refers", F.expr("if(first is not null and not (key <=> first), cast(first as string), null)"))
    eol = "\r\n"
    head = F.concat(
        F.lit(f"WARC/1.1{eol}WARC-Type: "),
        F.when(F.col("refers").isNull(), "response").otherwise("revisit"),
        F.lit(f"{eol}WARC-Record-ID: <urn:page:"), F.coalesce("id", F.lit("")),
        F.lit(f">{eol}WARC-Target-URI: "), F.col("url"),
        F.lit(f"{eol}WARC-Date: {DATE}{eol}WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.lit(f"{eol}X-Payload-Length: "), F.col("bytes").cast("string"),
        F.when(F.col("refers").isNull(), "").otherwise(F.concat(F.lit(f"{eol}WARC-Profile: {PROFILE}{eol}WARC-Refers-To: <urn:page:"), F.col("refers"), F.lit(">"))),
        F.lit(f"{eol}Content-Type: text/html; charset=utf-8{eol}Content-Length: "),
        F.when(F.col("refers").isNull(), F.col("bytes")).otherwise(0).cast("string"),
        F.lit(eol + eol),
        F.when(F.col("refers").isNull(), F.col("payload")).otherwise(""),
    )
    writer = marked.select(head.alias("value")).write.option("lineSep", eol + eol).option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip" if gzip else "none")
    writer.mode("overwrite").text(path)


# ---- reading


class Files(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)
        self.files = files


class WarcSource(DataSource):
    """``spark.read.format("warc")``. Options: path; payload=false leaves payloads null."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") == "true", int(self.options.get("partitionbytes", PARTITION_BYTES)))


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, partition_bytes: int):
        self.path, self.payload, self.partition_bytes = path, payload, partition_bytes
        self.wanted: list[tuple[str, frozenset | None]] = []

    def pushFilters(self, filters):
        """Takes equality, membership and not-null on header columns; the rest goes back."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in HEADERS and name != "payload_length" and isinstance(f, EqualTo):
                self.wanted.append((name, frozenset([f.value])))
            elif name in HEADERS and name != "payload_length" and isinstance(f, In):
                self.wanted.append((name, frozenset(f.value)))
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.wanted.append((name, None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        groups: list[list[str]] = [[]]
        size = 0
        for uri, n in listing(self.path, (".txt", ".warc", ".txt.gz", ".warc.gz")):
            if groups[-1] and size + n > self.partition_bytes:
                groups.append([])
                size = 0
            groups[-1].append(uri)
            size += n
        return [Files(g) for g in groups]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for uri in partition.files:
            for row in self._records(uri):
                rows.append(row)
                size += 500 + len(row[-1] or b"")
                if size > 4 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _records(self, uri: str) -> Iterator[tuple]:
        with opened(uri) as raw:
            scan = _Scan(_Unzipped(raw) if uri.endswith(".gz") else raw)
            while (headers := scan.headers()) is not None:
                length = int(headers.get("content-length", 0))
                fields = {c: _bare(c, headers.get(h)) for c, h in HEADERS.items()}
                take = all(fields[c] is not None and (values is None or fields[c] in values) for c, values in self.wanted)
                payload = scan.take(length) if take and self.payload else scan.skip(length)
                if take:
                    n = fields["payload_length"]
                    fields["payload_length"] = int(n) if n is not None else None
                    yield (*fields.values(), length, list(headers.items()), payload)


def _bare(column: str, value: str | None) -> str | None:
    if value is None:
        return None
    if column in ("record_id", "refers_to"):
        return value.removeprefix("<").removesuffix(">").removeprefix("urn:page:")
    return value.partition(":")[2] if column == "payload_digest" else value


_ARROW = pa.schema([*((c, pa.int64() if c == "payload_length" else pa.string()) for c in HEADERS), ("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


class _Unzipped:
    """A file of gzip members, read as one stream; seeking ahead reads on in pieces."""

    PIECE = 1 << 20

    def __init__(self, raw):
        self.stream = pa.CompressedInputStream(raw, "gzip")

    def read(self, n: int) -> bytes:
        return self.stream.read(n)

    def seek(self, n: int, whence: int) -> None:
        while n and (got := len(self.stream.read(min(n, self.PIECE)))):
            n -= got


class _Scan:
    """Buffered header scanner over a seekable file; skipped payloads aren't read."""

    CHUNK = 1 << 16
    MAX_HEADERS = 1 << 20

    def __init__(self, raw):
        self.raw, self.buffer, self.at = raw, b"", 0

    def _fill(self, most: int) -> bool:
        more = self.raw.read(most)
        self.buffer = self.buffer[self.at :] + more
        self.at = 0
        return bool(more)

    def headers(self) -> dict[str, str] | None:
        """The next record's headers by lower-case name; None at the end."""
        while True:
            while self.buffer[self.at : self.at + 2] == b"\r\n":
                self.at += 2
            end = self.buffer.find(b"\r\n\r\n", self.at)
            if end >= 0 and end - self.at > 2:
                break
            if len(self.buffer) - self.at > self.MAX_HEADERS:
                raise ValueError(f"no blank line within {self.MAX_HEADERS} bytes of headers")
            if not self._fill(self.CHUNK):
                return None
        lines = self.buffer[self.at : end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        self.at = end + 4
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n and self._fill(max(self.CHUNK, n)):
            pass
        out = self.buffer[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("a WARC record ends early")
        self.at += n
        return out

    def skip(self, n: int) -> None:
        held = len(self.buffer) - self.at
        if n <= held:
            self.at += n
        else:
            self.raw.seek(n - held, 1)
            self.buffer, self.at = b"", 0


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives under path. Filters on record_type and other header
    columns are pushed into the scan."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", path: str | None = None) -> DataFrame:
    """Writes pages to archives and reads them back: id, payload_bytes, payload_digest,
    record_type, refers_to.

    Responses are decoded and measured again from what was read; revisits are read by
    their headers alone.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    archive(pages, path, id_col, url_col, html_col)
    kind = pages.select(F.col(f"`{id_col}`")).schema[0].dataType.simpleString()
    ids = lambda c: F.expr(f"try_cast(nullif({c}, '') as {kind})")
    full = read(spark, path).where("record_type = 'response'")
    full = full.select(ids("record_id").alias(id_col), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", ids("refers_to").alias("refers_to"))
    again = read(spark, path, payload=False).where("record_type = 'revisit'")
    again = again.select(ids("record_id").alias(id_col), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", ids("refers_to").alias("refers_to"))
    return full.unionByName(again)
