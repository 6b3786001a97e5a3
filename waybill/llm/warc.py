"""WARC archives: a writer with revisit records and a splittable reader.

An archive is a file of gzip members, one record each.  Both directions go
through Spark's text source, so any file system that Spark reaches will do and
a lost task is written or read again:

* The writer hands over a member as a "line"; the line separator is an empty
  gzip member, which every gzip reader passes over.
* The reader's separator is the gzip magic.  A task gets the stretches between
  magics that start in its byte range, so it owns the records that do.  Each
  stretch is a candidate: it counts as a member only if its header and first
  bytes inflate to a WARC version line.  A magic that turns up inside
  compressed data fails this, and the stretch goes to the member before it;
  stretches that cross a range border are put together in a second step.

Names that end in ``.gz`` would make Spark unpack a file as one stream and lose
its members' borders; a codec that passes bytes through stands in for gzip.
Hadoop takes no compressed name for splittable, so such a file is one range.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm.common import attach_groups, shared_path

MAGIC = b"\x1f\x8b\x08"
#: A whole gzip member that unpacks to nothing.
EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")
#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1000
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_URN = "urn:page:"

RECORD_SCHEMA = "page_id long, target_uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_RECORD = pa.schema([("page_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _clean(value: str) -> str:
    """A header value without control characters."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def member(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """A record as a gzip member; with ``refers_to`` a revisit, which leaves its payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_URN}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    record = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _member_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([member(*row) for row in rows], pa.binary())], ["member"])


def write_archives(pages: DataFrame, path: str) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) to ``path``.

    Of rows with equal payloads of at least REVISIT_BYTES the one with the
    largest page_id is a response and the others revisit it.  Rows that share
    this page_id and payload are all responses, as are rows whose payload has no
    row with a page_id.  Null html is an empty payload; a null url is left out.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.cast("binary").alias("payload"), F.sha1(html.cast("binary")).alias("digest"))
    large = rows.where(F.octet_length("payload") >= REVISIT_BYTES).select("digest", "page_id")
    groups = large.groupBy("digest").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n"))
    rows = attach_groups(rows, groups.where("n > 1"), "digest", "n", F.xxhash64("page_id", "url"))
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("keep")), F.col("keep"))
    members = rows.select("page_id", "url", "payload", "digest", refers.alias("refers_to")).mapInArrow(_member_batches, "member binary")
    members.select(F.col("member").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


def parse_record(record: bytes, with_payload: bool) -> tuple:
    """The columns of RECORD_SCHEMA of an unpacked record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields.get("content-length", len(rest)))]
    kind = fields.get("warc-type")
    payload, length = block, None
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        for line in http.decode("latin-1").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            if name.strip().lower() == "content-length" and value.strip().isdigit():
                length = int(value)

    def page(field: str):
        value = fields.get(field, "").strip("<>").removeprefix(_URN)
        return int(value) if value.lstrip("-").isdigit() else None

    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "revisit":
        # The payload is elsewhere; its length and digest stand in the record.
        return page("warc-record-id"), fields.get("warc-target-uri"), kind, page("warc-refers-to"), length, stated, None
    found = hashlib.sha1(payload).hexdigest()
    if stated and len(stated) == 40 and stated != found:
        raise ValueError(f"payload of record {fields.get('warc-record-id')} has digest {found}, not {stated}")
    return page("warc-record-id"), fields.get("warc-target-uri"), kind, None, len(payload), found, payload if with_payload else None


class _Member:
    """A candidate that takes stretches until it is whole."""

    def __init__(self):
        self.inflate, self.out, self.raw, self.ok = zlib.decompressobj(31), [], [], True

    def take(self, piece: bytes) -> None:
        self.raw.append(piece)
        try:
            self.out.append(self.inflate.decompress(piece))
        except zlib.error:
            self.ok = False

    @property
    def whole(self) -> bool:
        return self.ok and self.inflate.eof

    def text(self) -> bytes:
        return b"".join(self.out)

    def begins(self) -> bool:
        """Whether this is known to be a member: its header inflates to a version line, or all of it to nothing."""
        return self.ok and (self.text()[:5] == b"WARC/" or self.inflate.eof and not self.text())


def _damaged(path: str) -> tuple:
    """What stands for a damaged member: the archive's path as its target."""
    return (None, path, "damaged", None, None, None, None)


def _record(text: bytes, with_payload: bool, path: str, errors: str) -> tuple:
    try:
        return parse_record(text, with_payload)
    except ValueError:
        if errors == "raise":
            raise
        return _damaged(path)


def _record_batches(with_payload: bool, errors: str):
    """From (path, start, stretch) in file order to records; pieces that need another range have ``piece`` set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        where, current, order = None, None, 0

        def piece(m: _Member) -> tuple:
            nonlocal order
            order += 1
            return (None,) * 7 + (where[0], where[1], order, b"".join(m.raw))

        def close():
            return [piece(current)] if current is not None else []

        def batch_of():
            columns = list(zip(*rows, strict=True)) if rows else [()] * 11
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)

        for batch in batches:
            for path, start, stretch in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                first = (path, start) != where
                if first:
                    rows += close()
                    where, current, order = (path, start), None, 0
                    if start == 0:
                        # What stands before a file's first magic is no member.
                        continue
                raw = MAGIC + (stretch or b"")
                if current is not None:
                    current.take(raw)
                    if not current.ok:
                        if errors == "raise":
                            raise ValueError(f"{path}: a gzip member that starts in the range at {start} is damaged")
                        # The next member may start right here.
                        rows.append((*_damaged(path), None, None, None, None))
                        current = _Member()
                        current.take(raw)
                        if not current.begins():
                            current = None
                            continue
                else:
                    current = _Member()
                    current.take(raw)
                    if not current.begins():
                        # It goes on with another range's member, or is too short to tell.
                        rows.append(piece(current))
                        current = None
                if current is not None and current.whole:
                    text = current.text()
                    if text:
                        rows.append((*_record(text, with_payload, path, errors), None, None, None, None))
                        held += len(text) if with_payload else 0
                    current = None
                if len(rows) >= 5000 or held > 16 << 20:
                    yield batch_of()
                    rows, held = [], 0
        rows += close()
        yield batch_of()

    return run


_PIECES = pa.schema([*_RECORD, ("path", pa.string()), ("start", pa.int64()), ("ord", pa.int64()), ("piece", pa.binary())])


def _stitch(with_payload: bool, errors: str):
    """Put the pieces of one file together, in order."""

    def run(table: pa.Table) -> pa.Table:
        rows, current, path = [], None, table["path"][0].as_py()
        for piece in table.sort_by([("start", "ascending"), ("ord", "ascending")])["piece"]:
            if current is None:
                current = _Member()
            current.take(piece.as_py())
            if not current.ok:
                if errors == "raise":
                    raise ValueError(f"{path}: a gzip member that crosses ranges is damaged")
                rows.append(_damaged(path))
                current = _Member()
                current.take(piece.as_py())
                if not current.begins():
                    current = None
                    continue
            if current.whole:
                if current.text():
                    rows.append(_record(current.text(), with_payload, path, errors))
                current = None
        if current is not None:
            if errors == "raise":
                raise ValueError(f"{path}: the last gzip member is cut short")
            rows.append(_damaged(path))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _RECORD, strict=True)], schema=_RECORD)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True, errors: str = "raise") -> DataFrame:
    """The records of the archives at ``path``: see RECORD_SCHEMA.

    Ranges follow ``spark.sql.files.maxPartitionBytes``; a file whose name ends
    in ``.gz`` is one range.  Empty members and empty files give nothing.
    Damaged or truncated archives raise an error, or with ``errors="row"`` give a
    row of record_type ``damaged`` with the archive's path as target_uri for each
    damaged member, and all other records.
    """
    lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1"))
    passing = spark.sparkContext._jvm.org.apache.hadoop.io.compress.PassthroughCodec
    lines = lines.option("io.compression.codecs", passing.CLASSNAME).option(passing.OPT_EXTENSION, ".gz").text(path)
    stretches = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("stretch"))
    found = stretches.mapInArrow(_record_batches(with_payload, errors), RECORD_SCHEMA + ", path string, start long, ord long, piece binary")
    whole = found.where("piece is null").drop("path", "start", "ord", "piece")
    crossing = found.where("piece is not null").select("path", "start", "ord", "piece").groupBy("path").applyInArrow(_stitch(with_payload, errors), RECORD_SCHEMA)
    return whole.unionByName(crossing)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back, without payloads."""
    path = shared_path(pages.sparkSession, "archives")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path, with_payload=False).drop("payload")
