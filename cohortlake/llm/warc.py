"""WARC archives of captures: written in sorted runs, their indexes merged, and read back.

Each task writes its captures in runs of bounded size, each sorted by URL key and time and stored as one
file of gzip members. The sorted index of every run is dealt into ranges of (key, time, id); inside
a range the runs' segments are merged by a loser tree into globally ordered capture histories.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.columns import by_bytes, check_columns
from cohortlake.session import scratch_path, settle

RUN_BYTES = 16 << 20  # payload bytes of one run
MIN_REVISIT = 100
EPOCH = 1704067200  # 2024-01-01, the time of id 0 where no time is given


class LoserTree:
    """Merges k sorted iterators: inner nodes hold the losers of their matches, so the next row takes log2(k) matches."""

    def __init__(self, runs: list[Iterator], key: Callable):
        self.runs, self.key, self.k = [iter(r) for r in runs], key, len(runs)
        self.head = [next(r, None) for r in self.runs]
        self.loser = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._play(leaf)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        kx, ky = self.key(x), self.key(y)
        return kx < ky or (kx == ky and a < b)

    def _play(self, leaf: int) -> None:
        """Play from a leaf to the root; in building, the first to reach a node waits there."""
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            waiting = self.loser[node]
            if waiting < 0:
                self.loser[node] = winner
                return
            if self._less(waiting, winner):
                self.loser[node], winner = winner, waiting
            node //= 2
        self.loser[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and self.head[self.loser[0]] is not None:
            won = self.loser[0]
            yield self.head[won]
            self.head[won] = next(self.runs[won], None)
            self._play(won)


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels in reverse, then path and query, in lower case where case does not count."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url or ""
    host = host.removeprefix("www.")
    labels = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return f"{labels}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _stamp(seconds: int) -> str:
    from datetime import datetime, timedelta

    try:
        return (datetime(1970, 1, 1) + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")
    except OverflowError:
        return "9999-12-31T23:59:59Z"


def record(page: int | None, url: str | None, seconds: int, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has no payload but names the response, the digest and the full length."""
    name = lambda n: f"<urn:capture:{'' if n is None else n}>"
    kind = "response" if refers_to is None else "revisit"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name(page)}",
        f"WARC-Date: {_stamp(seconds)}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._' + chr(39))}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of a record; the payload of a response is checked against its digest and length."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    payload = body.partition(b"\r\n\r\n")[2]
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
    if fields["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not hold the payload it names")
    number = lambda name: int(n) if (n := fields.get(name, "").removeprefix("<urn:capture:").removesuffix(">")) else None
    return {"id": number("WARC-Record-ID"), "type": fields["WARC-Type"], "digest": digest, "size": size, "refers_to": number("WARC-Refers-To"), "payload": payload}


_INDEX = pa.schema([("run", pa.string()), ("url_key", pa.string()), ("seconds", pa.int64()), ("id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
_INDEX_DDL = "run string, url_key string, seconds long, id long, offset long, length long"


def _order(row: dict) -> tuple:
    return row["url_key"], row["seconds"], -1 if row["id"] is None else row["id"]


def _write(folder: str, run_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        held, size = [], 0

        def done() -> pa.RecordBatch:
            held.sort(key=lambda x: _order(x[0]))
            name = f"{uuid.uuid4().hex}.warc.gz"  # a repeated task writes other files; only those of the one that counts are in the index
            rows, offset = [], 0
            with store.open_output_stream(f"{path}/{name}", compression=None) as out:
                for row, member in held:
                    rows.append(row | {"run": f"{folder}/{name}", "offset": offset, "length": len(member)})
                    out.write(member)
                    offset += len(member)
            return pa.RecordBatch.from_pylist(rows, schema=_INDEX)

        for batch in by_bytes(batches, "body", run_bytes):
            for r in batch.to_pylist():
                seconds = r["seconds"] if r["seconds"] is not None else EPOCH + (r["id"] or 0)
                packed = zlib.compressobj(1, zlib.DEFLATED, 31)
                raw = record(r["id"], r["url"], seconds, r["body"] or b"", r["digest"], r["size"], r["refers_to"])
                held.append(({"url_key": url_key(r["url"]), "seconds": seconds, "id": r["id"]}, packed.compress(raw) + packed.flush()))
                size += len(raw)
                if size > run_bytes:
                    yield done()
                    held, size = [], 0
        if held:
            yield done()

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Write one record per row below ``folder`` and give the index: run, url_key, seconds, id, offset, length.

    Of rows with equal payloads of at least 100 bytes the smallest id is the response and the others revisit
    it; null html is the empty payload, null ids are always responses. ``folder`` is on storage that all
    machines share, named as pyarrow's file systems do (file, hdfs, s3, gs).
    """
    check_columns(pages, id_col, url_col, html_col)
    body = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary")
    seconds = F.unix_timestamp(F.col(f"`{time_col}`")) if time_col else F.lit(None)
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), seconds.cast("long").alias("seconds"),
        body.alias("body"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("size"),
    )
    large = rows.where((F.col("size") >= MIN_REVISIT) & F.col("id").isNotNull())
    first = large.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    again = settle(large.select("id", "digest").join(first, "digest").where("id != first").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to")).distinct(), "revisits")
    marked = rows.join(again, (F.col("id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").drop("_id", "_digest")
    marked = marked.withColumn("body", F.when(F.col("refers_to").isNull(), F.col("body")))
    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    return settle(marked.mapInArrow(_write(folder, run_bytes), _INDEX_DDL), "warc-index")


def merge_indexes(index: DataFrame) -> DataFrame:
    """Capture histories in global order: the index with ``range`` and ``position`` (order inside the range).

    Ranges split by URL key, time and id, so one host or URL may fill many. In each range the
    runs' segments arrive sorted and a loser tree merges them; ties keep the order of the runs.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[dict]] = {}
        where = 0
        for batch in batches:
            for row in batch.to_pylist():
                where = row.pop("range")
                runs.setdefault(row["run"], []).append(row)
        rows: list[dict] = []
        for position, row in enumerate(LoserTree([iter(runs[r]) for r in sorted(runs)], _order)):
            rows.append(row | {"range": where, "position": position})
            if len(rows) == 10_000:
                yield pa.RecordBatch.from_pylist(rows, schema=out)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    out = pa.schema([*_INDEX, ("range", pa.int64()), ("position", pa.int64())])
    dealt = index.repartitionByRange("url_key", "seconds", "id").sortWithinPartitions("run", "offset")
    return dealt.withColumn("range", F.spark_partition_id().cast("long")).mapInArrow(merge, f"{_INDEX_DDL}, range long, position long")


def read_archives(index: DataFrame, payloads: bool = False) -> DataFrame:
    """Records behind an index: id, payload_bytes, payload_digest, record_type, refers_to, and the payload if asked.

    Every file is opened once by one task and read record by record; payloads are checked against their digests.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            for part in range(0, batch.num_rows, 500):
                rows = []
                for r in batch.slice(part, 500).to_pylist():
                    if r["run"] != name:
                        if file is not None:
                            file.close()
                        name, (store, path) = r["run"], _store(r["run"])
                        file = store.open_input_file(path)
                    file.seek(r["offset"])
                    found = parse(zlib.decompress(file.read(r["length"]), 31))
                    rows.append((found["id"], found["size"], found["digest"], found["type"], found["refers_to"], *([found["payload"]] if payloads else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))
        if file is not None:
            file.close()

    fields = [pa.field("id", pa.int64()), pa.field("payload_bytes", pa.int64()), pa.field("payload_digest", pa.string()), pa.field("record_type", pa.string()), pa.field("refers_to", pa.int64())]
    fields += [pa.field("payload", pa.binary())] if payloads else []
    ddl = "id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if payloads else "")
    return index.select("run", "offset", "length").repartition("run").sortWithinPartitions("run", "offset").mapInArrow(read, ddl)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Write the pages, merge the runs' indexes, and read every capture back in one row: id, payload_bytes, ...

    An empty table gives an empty table. Rows that repeat an id are archived each; those with the smallest
    id of equal payloads are all responses. Columns other than the three named are not read.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    histories = settle(merge_indexes(write_archives(pages, folder, id_col, url_col, html_col, run_bytes=run_bytes)), "capture-histories")
    return read_archives(histories).withColumnRenamed("id", id_col)
