"""WARC archives and their index.

Records (WARC/1.1, one gzip member each) are written by executors into archives of bounded size, each a row of a Parquet table in the
shared folder: the file systems of a cluster are reached by Spark's writers only. Of equal payloads the record of the largest page_id is the
response, the others revisit it. Reading parses every member, sorts an archive's captures locally by URL key and timestamp (a
run), and merges all runs externally: runs are sliced at common key boundaries, and each range is merged by a loser tree. Ranges in order make one
globally ordered capture history.

A null html is an empty payload. Repeated rows of one page_id are all responses if that id is the largest. A null page_id revisits
the largest one if there is any. A null url has the empty key. Empty tables give empty results; extra columns are left aside.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramlode.llm.common import dealt, saved

#: Bytes of an archive row, revisits that are broadcast at most (beyond, they are joined by a shuffle), captures in a range in the mean,
#: ranges at most (with more captures, ranges grow) and keys sampled for each.
ARCHIVE_BYTES, BROADCAST_ROWS, RANGE_ROWS, MOST_RANGES, SAMPLED = 8 << 20, 500_000, 20_000, 20_000, 8
#: Seconds since 1970 to which the page_id is added where a page has no time of its own.
START = 1_704_067_200
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CAPTURE = "url_key string, ts long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def base32_sha1(payload: Column) -> Column:
    """Twenty bits, 5 hex digits, are 4 digits of base 32."""
    h = F.sha1(payload)
    parts = [F.lpad(F.upper(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32)), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, payload_digest, refers_to) of the pages whose payload a larger page_id has too."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    slim = pages.select("page_id", F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload).alias("payload_digest")).filter(F.col("payload_bytes") >= least_bytes)
    slim = saved(slim, "warc-digests")
    groups = slim.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null")
    return slim.join(groups, ["payload_digest", "payload_bytes"]).filter("page_id is null or page_id < refers_to").select("page_id", "payload_digest", "refers_to").distinct()


def url_key(url: str | None) -> str:
    """Host with its labels reversed, then path and query, lower-cased: example.com/a becomes com,example)/a."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
    except ValueError:
        return url.lower()
    host = (parts.netloc.rpartition("@")[2].partition(":")[0]).removeprefix("www.")
    return (",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + ("?" + parts.query if parts.query else "")).lower()


def _stamp(ts: int) -> str:
    import datetime

    return datetime.datetime.fromtimestamp(ts, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id, url: str, ts: int, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record, compressed as a gzip member. A revisit has the HTTP head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    safe = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_stamp(ts)}",
        f"WARC-Target-URI: {safe}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _write(batches: Iterator) -> Iterator:
    import pyarrow as pa

    held, size, name = [], 0, hashlib.sha1()

    def out():
        return pa.RecordBatch.from_arrays([pa.array([name.hexdigest()[:24]]), pa.array([b"".join(held)], pa.binary())], names=["archive", "warc"])

    for batch in batches:
        for page_id, url, ts, html, digest, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "ts", "html", "payload_digest", "refers_to"))):
            page_id, payload = page_id.as_py(), (html.as_py() or "").encode()
            held.append(record(page_id, url.as_py(), ts.as_py() or 0, payload, digest.as_py(), refers_to.as_py()))
            name.update(held[-1])
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield out()
                held, size, name = [], 0, hashlib.sha1()
    if held:
        yield out()


def write_warc(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """(archive, warc): archives as rows. ``warc`` is the content of a .warc.gz file."""
    ids = F.col("page_id").cast("long")
    ts = (F.col("ts").cast("long") if dict(pages.dtypes).get("ts") == "timestamp" else START + F.coalesce(ids, F.lit(0)) % 1_000_000_000).alias("ts")
    pages = pages.select(ids.alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), ts)
    copies = saved(revisits(pages, least_bytes), "warc-revisits")
    if copies.count() <= BROADCAST_ROWS:
        copies = F.broadcast(copies)
    copies = copies.withColumnRenamed("page_id", "p").withColumnRenamed("payload_digest", "d")
    full = pages.withColumn("payload_digest", base32_sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")))
    full = full.join(copies, full.payload_digest.eqNullSafe(F.col("d")) & full.page_id.eqNullSafe(F.col("p")), "left").drop("p", "d")
    return saved(full.mapInArrow(_write, "archive string, warc binary"), "warc")


def parse(warc: bytes) -> Iterator[tuple[dict, bytes, int, int]]:
    """Header fields, block, offset and length of each record of an archive."""
    at = 0
    while at < len(warc):
        unpacker = zlib.decompressobj(31)
        raw = unpacker.decompress(memoryview(warc)[at : at + (1 << 16)])
        fed = min(1 << 16, len(warc) - at)
        parts = [raw]
        while not unpacker.eof:
            if at + fed >= len(warc):
                raise ValueError("an archive ends within a record")
            parts.append(unpacker.decompress(memoryview(warc)[at + fed : at + fed + (1 << 18)]))
            fed = min(fed + (1 << 18), len(warc) - at)
        used = fed - len(unpacker.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        rows = head.decode().split("\r\n")
        if rows[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        fields = dict(r.split(": ", 1) for r in rows[1:])
        n = int(fields["Content-Length"])
        if len(rest) != n + 4:
            raise ValueError("a record's length is wrong")
        yield fields, rest[:n], at, used
        at += used


def _page(urn: str) -> int | None:
    n = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(n) if n else None


def captures(archive: str, warc: bytes) -> list[tuple]:
    """An archive's run: its captures, sorted by URL key, timestamp and page. Payload digests are verified."""
    import datetime

    run = []
    for fields, block, offset, length in parse(warc):
        http, _, payload = block.partition(b"\r\n\r\n")
        n = int(next(r for r in http.split(b"\r\n") if r.lower().startswith(b"content-length:"))[15:])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if fields["WARC-Type"] == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"{fields['WARC-Record-ID']}: payload and digest differ")
        ts = int(datetime.datetime.strptime(fields["WARC-Date"] + "+0000", "%Y-%m-%dT%H:%M:%SZ%z").timestamp())
        refers = fields.get("WARC-Refers-To")
        run.append((url_key(fields["WARC-Target-URI"]), ts, _page(fields["WARC-Record-ID"]), n, digest, fields["WARC-Type"], _page(refers) if refers else None, archive, offset, length))
    return sorted(run, key=_order)


def _order(capture: tuple) -> tuple:
    return (capture[0], capture[1], capture[2] is not None, capture[2] or 0, capture[7], capture[8])


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so that a new head replays one path to the root."""

    def __init__(self, runs: list[Iterable[tuple]]):
        self.runs = [iter(r) for r in runs]
        k = len(runs)
        self.heads = [self._next(i) for i in range(k)]
        self.losers = [-1] * k
        for i in range(k):
            self._replay(i)

    def _next(self, i: int):
        item = next(self.runs[i], None)
        return None if item is None else (_order(item), item)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x[0], a) < (y[0], b))

    def _replay(self, i: int) -> None:
        node, winner = (i + len(self.losers)) // 2, i
        while node > 0:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = winner
                return
            if self._less(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.losers and self.heads[self.losers[0]] is not None:
            w = self.losers[0]
            yield self.heads[w][1]
            self.heads[w] = self._next(w)
            self._replay(w)


def _runs(archives: DataFrame) -> DataFrame:
    """(archive, run): the parsed and locally sorted captures of each archive."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fields = _arrow_fields()
        for batch in batches:
            for archive, warc in zip(batch.column(0).to_pylist(), batch.column(1)):
                run = captures(archive, warc.as_py())
                cols = list(zip(*run))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields)], schema=pa.schema(fields))

    return archives.mapInArrow(read, CAPTURE)


def _arrow_fields():
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64()}
    return [pa.field(name, kinds[kind]) for name, kind in (c.split() for c in CAPTURE.split(", "))]


def history(archives: DataFrame) -> DataFrame:
    """All captures in global order: (range, position) sorts them; prior_ts is the URL key's capture before."""
    runs = saved(_runs(archives), "warc-runs")
    n = runs.count()
    ranges = min(MOST_RANGES, max(1, -(-n // RANGE_ROWS)))
    # boundaries from a sample by hash, of MOST_RANGES * SAMPLED keys at most in the mean
    key = F.struct("url_key", "ts", F.coalesce("page_id", F.lit(-1)).alias("page_id"))
    share = min(1.0, SAMPLED * ranges / max(n, 1))
    sample = sorted(tuple(r.k) for r in runs.filter(F.pmod(F.xxhash64("url_key", "ts", "page_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select(key.alias("k")).collect()) if ranges > 1 else []
    bounds = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []

    def sliced(batches: Iterator) -> Iterator:
        """A run's rows come in order: its slices are found by bisection."""
        import bisect

        import pyarrow as pa

        for batch in batches:
            keys = [(a, b, -1 if c is None else c) for a, b, c in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            parts = [bisect.bisect_right(bounds, k) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *batch.columns], names=["range", *batch.schema.names])

    def merged(key, rows):
        import pyarrow as pa

        by_run: dict[str, list] = {}
        for c in zip(*(rows.column(i).to_pylist() for i in range(1, rows.num_columns))):
            by_run.setdefault(c[7], []).append(c)
        runs = [sorted(r, key=_order) for _, r in sorted(by_run.items())]  # sorted already, unless the shuffle broke their order: then linear
        out, prior, last = [], [], (None, None)
        for c in LoserTree(runs):
            prior.append(last[1] if last[0] == c[0] else None)
            last = (c[0], c[1])
            out.append(c)
        cols = list(zip(*out))
        fields = _arrow_fields()
        return pa.table([pa.array([key[0].as_py()] * len(out), pa.int32()), pa.array(range(len(out)), pa.int64()), pa.array(prior, pa.int64()), *(pa.array(c, f.type) for c, f in zip(cols, fields))], names=["range", "position", "prior_ts", *(f.name for f in fields)])

    cut = runs.mapInArrow(sliced, f"range int, {CAPTURE}")
    whole = saved(dealt(cut, "range", ranges).groupBy("range").applyInArrow(merged, f"range int, position long, prior_ts long, {CAPTURE}"), "warc-history")
    # what a range ends with goes on to the next one: a row for each range, MOST_RANGES at most
    ends = whole.groupBy("range").agg(F.max(F.struct("position", "url_key", "ts")).alias("end"))
    order = Window.orderBy("range")
    before = F.broadcast(ends.select(F.col("range"), F.lag("end.url_key").over(order).alias("end_key"), F.lag("end.ts").over(order).alias("end_ts")))
    carried = F.when((F.col("position") == 0) & (F.col("url_key") == F.col("end_key")), F.col("end_ts")).otherwise(F.col("prior_ts"))
    return whole.join(before, "range", "left").select("range", "position", carried.alias("prior_ts"), *whole.columns[3:])


def export(archives: DataFrame, folder: str) -> list[str]:
    """Archives as .warc.gz files in a folder of the driver, one at a time."""
    import os

    os.makedirs(folder, exist_ok=True)
    names = []
    for row in archives.toLocalIterator():
        names.append(os.path.join(folder, f"{row.archive}.warc.gz"))
        with open(names[-1], "wb") as f:
            f.write(row.warc)
    return names
