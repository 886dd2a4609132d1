"""WARC archives: writing, normalising to one gzip member per record, reading by offset index."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollmill.llm.common import blocks, group_value, numbered_blocks, run_dir, side_rows, store_side, table, written

ARCHIVE_BYTES = 256 << 20  # uncompressed; an archive ends with the record that passes it
CHUNK = 1 << 20
ROW_BYTES = 256  # that a page counts in a block beside its html, so that a block of empty pages is bounded too
LEVEL = 4
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
INDEX = "archive string, offset bigint, length bigint, record_id string, record_type string"
RECORDS = (
    "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
)


def digest(payload: bytes) -> str:
    """SHA-1 in base32, as WARC headers carry it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _urn(page: int | None, uid: int) -> str:
    return f"<urn:x-page:{'' if page is None else page}:{uid}>"


def _page(urn: str | None) -> int | None:
    number = urn.split(":")[2] if urn else ""
    return int(number) if number else None


def record_bytes(row: dict) -> bytes:
    """One WARC record of a page: its HTTP response, or a revisit that keeps the HTTP headers only."""
    payload = (row["html"] or "").encode()
    block = HTTP % len(payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {_urn(row['page_id'], row['uid'])}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + " ".join(row["url"].split()))
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Refers-To: {_urn(row['refers_to'], row['refers_uid'])}")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    else:
        block += payload
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, uid, record_type, refers_to, refers_uid of each row.

    Of rows with equal payloads of `least` bytes or more the one with the smallest page_id is the
    response (rows without an id come last, equal ids by the order of the table), the others revisit
    it. Payloads meet by two hashes and their length, in lanes, so that a payload which a third of
    all rows share is spread. Rows are numbered once, in a stored copy; what a page revisits is stored by
    block, so that the scan which writes the pages picks it up and no payload moves.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("uid", F.monotonically_increasing_id())
    rows = numbered_blocks(rows, "html", "numbered", each=ROW_BYTES)
    first = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id"), F.col("uid"))
    keys = rows.select("uid", F.col("_block").alias("block"), F.sha1(body.cast("binary")).alias("sha"), F.octet_length(body).alias("size"), first.alias("me"))
    roles = group_value(keys, ["sha", "size"], F.col("uid"), first=("min", F.col("me")))
    revisits = roles.where((F.col("size") >= least) & (F.col("first") != F.col("me")))
    path = store_side(revisits.select("block", "uid", F.col("first.page_id").alias("refers_to"), F.col("first.uid").alias("refers_uid")), "revisits")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part in blocks(batches):
            kind, refers = pa.array(["response", "revisit"]), [pa.nulls(len(part), pa.int64())] * 2
            again = np.zeros(len(part), bool)
            if (side := side_rows(path, block)) is not None:
                side = side.sort_by("uid")
                uid, known = part.column("uid").to_numpy(), side.column("uid").to_numpy()
                at = np.minimum(np.searchsorted(known, uid), len(known) - 1)
                again = known[at] == uid
                at = pa.array(at, mask=~again)
                refers = [side.column(c).combine_chunks().take(at) for c in ("refers_to", "refers_uid")]
            told = pa.table([*part.columns, kind.take(pa.array(again.astype(np.int64))), *refers], [*part.column_names, "record_type", "refers_to", "refers_uid"])
            yield from told.to_batches()

    return rows.mapInArrow(add, "page_id bigint, url string, html string, uid bigint, record_type string, refers_to bigint, refers_uid bigint")


def write_monolithic(records: DataFrame, path: str, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows of `with_revisits` as archives of one gzip stream each; a row per archive.

    Files have names of their own for each attempt at a task; only those of the returned table count.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        store.create_dir(root, recursive=True)
        out = None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out, gz = store.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(LEVEL, wbits=31)
                data = record_bytes(row)
                size += len(data)
                out.write(gz.compress(data))
                if size >= limit:
                    out.write(gz.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"archive": [name], "bytes": [size]})
        if out is not None:
            out.write(gz.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [name], "bytes": [size]})

    return written(records.mapInArrow(write, "archive string, bytes bigint"), "archives")


def _inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file with one or many members, a bounded piece at a time."""
    gz = zlib.decompressobj(31)
    while data := source.read(CHUNK):
        while data:
            yield gz.decompress(data, CHUNK)
            data = gz.unconsumed_tail
            if gz.eof:
                data, gz = gz.unused_data, zlib.decompressobj(31)
    if tail := gz.flush():
        yield tail


class _Buffer:
    """Reads lines and counted bytes from pieces."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.data, self.at = iter(pieces), b"", 0

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.data, self.at = self.data[self.at :] + piece, 0
        return True

    def head(self) -> bytes | None:
        """Up to an empty line, both line ends included; None at the end."""
        while (end := self.data.find(b"\r\n\r\n", self.at)) < 0:
            if not self._more():
                if self.data[self.at :].strip():
                    raise ValueError("the archive ends within a record's header")
                return None
        start, self.at = self.at, end + 4
        return self.data[start : self.at]

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if self.at == len(self.data) and not self._more():
                raise ValueError("the archive ends within a record")
            piece = self.data[self.at : self.at + n]
            self.at += len(piece)
            n -= len(piece)
            yield piece


def headers(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def normalise(spark: SparkSession, archives: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite each archive with one gzip member per record, and write an offset index beside it.

    An archive is inflated once, in pieces; neither it nor a record is held whole. The new archive has
    the old name, its index that name and `.idx`, one JSON line per record. Both are written under
    other names and moved when complete, so that a repeated task leaves the same two files. Returns
    the index of all archives, read from the sidecar files. Archives that end within a record raise.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (here, old), (there, new) = _store(source), _store(target)
        there.create_dir(new, recursive=True)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                draft = f"{new}/_{uuid.uuid4().hex}"
                offset, n = 0, 0
                with (
                    here.open_input_stream(f"{old}/{name}", compression=None) as inp,
                    there.open_output_stream(draft, compression=None) as out,
                    there.open_output_stream(f"{draft}.idx", compression=None) as idx,
                ):
                    data = _Buffer(_inflated(inp))
                    while (head := data.head()) is not None:
                        fields = headers(head)
                        gz = zlib.compressobj(LEVEL, wbits=31)
                        length = out.write(gz.compress(head))
                        for piece in data.take(int(fields["content-length"]) + 4):
                            length += out.write(gz.compress(piece))
                        length += out.write(gz.flush())
                        line = {
                            "archive": name,
                            "offset": offset,
                            "length": length,
                            "record_id": fields.get("warc-record-id"),
                            "record_type": fields.get("warc-type"),
                        }
                        idx.write(json.dumps(line).encode() + b"\n")
                        offset, n = offset + length, n + 1
                there.move(draft, f"{new}/{name}")
                there.move(f"{draft}.idx", f"{new}/{name}.idx")
                yield pa.RecordBatch.from_pydict({"archive": [name], "records": [n]})

    # a fixed number, so that few short rows don't end up in one task
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    done = written(archives.repartition(tasks, "archive").select("archive").mapInArrow(rewrite, "archive string, records bigint"), "normalised")
    if not done.head(1):
        return spark.createDataFrame([], INDEX)
    return spark.read.schema(INDEX).json(f"{target}/*.idx")


def read_records(index: DataFrame, path: str) -> DataFrame:
    """The record at each index row, by a ranged read of its member; payloads of revisits are null.

    payload_bytes and payload_digest are those of the full payload: of a response measured again here
    (another digest than its header's raises), of a revisit as its headers say.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(path)
        name = file = None
        for batch in batches:
            rows = []
            for at in sorted(batch.to_pylist(), key=lambda r: (r["archive"], r["offset"])):
                if at["archive"] != name:
                    if file:
                        file.close()
                    name, file = at["archive"], store.open_input_file(f"{root}/{at['archive']}")
                file.seek(at["offset"])
                data = zlib.decompress(file.read(at["length"]), 31)
                end = data.index(b"\r\n\r\n") + 4
                fields = headers(data[:end])
                block = io.BytesIO(data[end : end + int(fields["content-length"])])
                size = None
                while (line := block.readline()) not in (b"\r\n", b""):
                    if line.lower().startswith(b"content-length:"):
                        size = int(line.split(b":")[1])
                known = fields["warc-payload-digest"].removeprefix("sha1:")
                payload = None
                if fields["warc-type"] != "revisit":
                    payload = block.read()
                    size = len(payload)
                    if digest(payload) != known:
                        raise ValueError(f"{at['record_id']}: the payload does not have its digest")
                rows.append(
                    {
                        "page_id": _page(fields["warc-record-id"]),
                        "url": fields.get("warc-target-uri"),
                        "record_type": fields["warc-type"],
                        "payload_bytes": size,
                        "payload_digest": known,
                        "refers_to": _page(fields.get("warc-refers-to")),
                        "payload": payload,
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, kind)
        if file:
            file.close()

    kind = pa.schema(
        [
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("record_type", pa.string()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("refers_to", pa.int64()),
            ("payload", pa.binary()),
        ]
    )
    return index.mapInArrow(read, RECORDS)


def archive_pages(spark: SparkSession, pages: DataFrame, least: int = 0, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every page to monolithic archives, normalise these, and read all records back.

    Files go below the shared folder. Columns other than page_id, url and html do not enter archives. A
    null html is an empty payload, a null url writes no target, white space within one becomes a blank.
    Repeated rows each get a record; of those with equal id and payload one is the response and the
    others refer to its id. No rows give no archives and no records.
    """
    home = run_dir(spark, "warc")
    archives = write_monolithic(with_revisits(pages, least), f"{home}/whole", limit)
    index = normalise(spark, archives, f"{home}/whole", f"{home}/records")
    return read_records(index, f"{home}/records")


def op4_warc(spark, sf_dir):
    return archive_pages(spark, table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
