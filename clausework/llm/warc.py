"""WARC archives of pages, with revisits of equal payloads and a merged capture index.

Pages are written as WARC/1.1 records in text files of the shared folder. Reading turns
each task's archives into one locally sorted run of index entries in the shared folder; entries
are dealt by ranges of (url key, timestamp, page) of a bounded number of entries, and in each
range a loser tree merges the runs, so that the index as a whole holds every URL's captures in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm.scratch import materialize, new_path

LEAST_REVISIT = 1000
#: Records in an archive at most, by the size of their payloads in bytes: an archive stays far below what a task can hold.
ARCHIVES = ((64 << 10, 1000), (1 << 20, 128), (None, 4))
#: Index entries that a range is made for; a merging task holds about that many.
RANGE_ENTRIES = 100_000
#: Record separator of the format, and the time of page 0; a page's time is its id in seconds after that.
END = "\r\n\r\n"
EPOCH = 1_577_836_800
INDEX_FIELDS = ("url_key", "captured", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "record_no")
INDEX_SCHEMA = "url_key string, captured string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, record_no long, run string"


def _records(pages: DataFrame) -> DataFrame:
    """One row (value) per page: the text of its record without the final separator."""
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", payload.alias("html"), F.octet_length(payload).cast("long").alias("size"), F.sha1(payload).alias("digest"))
    # the largest page of each payload, found on slim rows; the join's sides can be split for a hot payload
    least = keyed.where(f"size >= {LEAST_REVISIT}").groupBy("digest", "size").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1")
    least = materialize(least.drop("n"), "payloads")
    joined = keyed.join(least, ["digest", "size"], "left")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    crlf = F.lit("\r\n")
    lines = lambda *parts: F.concat(*[x for p in parts for x in (p, crlf)])
    label = lambda name, value: F.concat(F.lit(name + ": "), value)
    text = lambda c: F.coalesce(F.regexp_replace(c.cast("string"), "[\r\n]", ""), F.lit(""))
    http = F.concat(lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=UTF-8"), label("Content-Length", F.col("size").cast("string"))), crlf)
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    date = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.pmod("page_id", F.lit(10**9)), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = lines(
        F.lit("WARC/1.1"),
        label("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        label("WARC-Record-ID", F.concat(F.lit("<urn:page:"), text(F.col("page_id")), F.lit(">"))),
        label("WARC-Target-URI", text(F.col("url"))),
        label("WARC-Date", date),
        label("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        label("Content-Length", F.octet_length(block).cast("string")),
    )
    extra = F.when(revisit, lines(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), label("WARC-Refers-To", F.concat(F.lit("<urn:page:"), text(F.col("original")), F.lit(">"))))).otherwise(F.lit(""))
    no_url = F.when(F.col("url").isNull(), F.lit("X-No-Target: 1\r\n")).otherwise(F.lit(""))
    return joined.select("size", F.concat(head, extra, no_url, crlf, block).alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write a WARC record for every row of ``pages`` (page_id, url, html; a null html is empty).

    Of the records with equal payloads of at least 1000 bytes, that with the largest page_id is a
    response (all of them, should that id repeat) and the others are revisits without payload. A
    payload that only has null ids is always a response. Other columns are ignored. Records of a
    size class of ARCHIVES share archives; a class that no page is in costs no pass.
    """
    sizes = pages.select(F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    bounds = [(0 if k == 0 else ARCHIVES[k - 1][0], most, records) for k, (most, records) in enumerate(ARCHIVES)]
    inside = lambda low, most: (F.col("size") >= low) & (F.lit(True) if most is None else F.col("size") < most)
    found = sizes.agg(*[F.count_if(inside(low, most)).alias(f"n{k}") for k, (low, most, _) in enumerate(bounds)]).first()
    records = _records(pages)
    for k, (low, most, per_file) in enumerate(bounds):
        if found[f"n{k}"] or k == 0:
            own = records.where(inside(low, most)).select("value")
            own.write.mode("append").option("lineSep", END).option("compression", "none").option("maxRecordsPerFile", per_file).text(path)


def url_key(url: str | None) -> str:
    """Sort-friendly form: reversed host, then path and query; empty without a URL."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").lower()
    except ValueError:
        return url
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _id(value: bytes | None) -> int | None:
    found = value[len("<urn:page:") : -1] if value else b""
    return int(found) if found else None


def parse_archive(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes, bytes]]:
    """(WARC headers, HTTP headers, payload) of each record, by the lengths that the headers give."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].split(b"\r\n")[1:]
        headers = dict(line.split(b": ", 1) if b": " in line else (line.rstrip(b":"), b"") for line in lines)
        start = end + 4
        stop = start + int(headers[b"Content-Length"])
        body = start if stop == start else data.index(b"\r\n\r\n", start, stop) + 4
        yield headers, data[start:body], data[body:stop]
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"no end of record at byte {stop}")
        at = stop + 4


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted run of the entries of all of a task's archives, named by the first of them. Payloads are read one archive at a time."""
    rows: list[tuple] = []
    run = ""
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            name = path.rsplit("/", 1)[-1]
            run = run or name
            for no, (h, http, payload) in enumerate(parse_archive(data)):
                kind = h[b"WARC-Type"].decode()
                digest = h[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
                size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"record {no} of {name} is damaged")
                url = None if b"X-No-Target" in h else h[b"WARC-Target-URI"].decode("utf-8", "replace")
                rows.append((url_key(url), h[b"WARC-Date"].decode(), _id(h[b"WARC-Record-ID"]), url, size, digest, kind, _id(h.get(b"WARC-Refers-To")), name, no))
    rows.sort(key=_order)
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
    for lo in range(0, len(rows), 10_000):
        lot = rows[lo : lo + 10_000]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*lot, strict=True), kinds, strict=True)), pa.array([run] * len(lot), pa.string())], names=[*INDEX_FIELDS, "run"])


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


def loser_tree_merge(runs: list[list[tuple]]) -> Iterator[tuple]:
    """Merge sorted runs: each inner node keeps the loser of its match, so a new head replays one path to the root."""
    k = len(runs)
    heads = [0] * k
    key = lambda r: (0, *_order(runs[r][heads[r]]), r) if heads[r] < len(runs[r]) else (1, r)
    keys = [key(r) for r in range(k)]
    losers = [-1] * max(1, k)

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        winner, losers[node] = (a, b) if keys[a] <= keys[b] else (b, a)
        return winner

    winner = play(1) if k else -1
    while k and keys[winner][0] == 0:
        yield runs[winner][heads[winner]]
        heads[winner] += 1
        keys[winner] = key(winner)
        node = (winner + k) // 2
        while node:
            if keys[losers[node]] < keys[winner]:
                losers[node], winner = winner, losers[node]
            node //= 2


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range's entries: merge its runs and hand them on in lots.

    A run's entries come in its order, in one piece for each task that read a part of it; a piece
    ends where the order falls, so nothing is sorted again whatever order the pieces come in.
    """
    pieces: dict[str, list[list[tuple]]] = {}
    schema = None
    for batch in batches:
        schema = batch.schema
        names = batch.column(len(INDEX_FIELDS)).to_pylist()
        for run, row in zip(names, zip(*(batch.column(i).to_pylist() for i in range(len(INDEX_FIELDS))), strict=True), strict=True):
            own = pieces.setdefault(run, [])
            if not own or _order(row) < _order(own[-1][-1]):
                own.append([])
            own[-1].append(row)
    if schema is None:
        return
    lot: list[tuple] = []
    fields = [schema.field(i) for i in range(len(INDEX_FIELDS))]

    def out(lot: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*lot, strict=True), fields, strict=True)], names=[f.name for f in fields])

    for row in loser_tree_merge([piece for own in pieces.values() for piece in own]):
        lot.append(row)
        if len(lot) == 10_000:
            yield out(lot)
            lot = []
    if lot:
        yield out(lot)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The capture index of the archives under ``path``, range-sorted by (url_key, captured, page_id).

    Every response's payload is held against its length and digest; a damaged archive fails
    the job. Payloads stay in the archives: runs and ranges hold index entries only, as many
    ranges as give each about RANGE_ENTRIES of them, whatever the table's size; the captures of
    one URL can span several ranges.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")
    entries = materialize(files.mapInArrow(_runs, INDEX_SCHEMA), "capture-runs")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // RANGE_ENTRIES))
    dealt = entries.repartitionByRange(ranges, "url_key", "captured", "page_id", "archive", "record_no")
    return dealt.mapInArrow(_merge, INDEX_SCHEMA.rsplit(",", 1)[0])


def capture_history(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read their merged index back.

    Returns one row per input row (page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, captured, url_key, archive, record_no), ordered by url_key, captured, page_id.
    Null page_ids and urls come back as null; repeated rows are records of their own. An empty
    table gives no rows.
    """
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_index(pages.sparkSession, path)
