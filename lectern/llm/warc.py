"""WARC archives: a writer with revisit records, and a splittable reader.

Writing: one gzip member per record. Of records with equal payloads of at least `least` bytes the one
with the largest page_id is a response, the others are revisits that name it. Which one that is comes
from counts by digest; digests that repeat are joined back under a salt, so that a payload that a third
of all pages share is dealt over many tasks. Files roll over at `roll` bytes.

Reading: a task has a byte range of a file. It looks for the gzip magic, inflates the start of each
candidate and takes it for a record only if a WARC header can be read there; it owns the records that
start inside its range and reads the last one beyond the end of the range. After a record the next
one starts at the next byte, so only the first is searched for.

Defined results: a null html is an empty payload, a null url has no target line, a null page_id is
smaller than any other and stays null; rows that repeat the largest page_id are responses each; an empty
table writes no file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh_dir, stored
from .files import new_output, read_range

GZIP = b"\x1f\x8b\x08"
BLOCK = 1 << 18
SALTS = 16
DATE = "2020-01-01T00:00:00Z"
MOST_TASKS = 50_000


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, uncompressed."""
    head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    block = "\r\n".join(head).encode() + (b"" if revisit else payload)
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {record_id(refers_to)}")
        if refers_to is not None:
            lines.append(f"Refers-To-Page-ID: {refers_to}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_warc(pages: DataFrame, folder: str, least: int = 0, roll: int = 64 << 20) -> DataFrame:
    """Writes the archives; returns their manifest (path, length, n_records), one row per file."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn(
        "sha", F.sha1(F.encode("html", "UTF-8"))
    ).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    copies = (
        rows.where(F.octet_length("html") >= least)
        .groupBy("sha").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    marked = rows.join(copies, ["sha", "salt"], "left").withColumn(
        "revisit", F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, out, path, size, n = TaskContext.get().partitionId(), None, None, 0, 0
        made = []
        for batch in batches:
            for page, url, html, first, revisit in zip(*(batch[c] for c in ("page_id", "url", "html", "first_id", "revisit"))):
                if out is None:
                    path, out = new_output(folder, f"pages-{part:06d}-{len(made):04d}.warc.gz")
                    size = n = 0
                data = member(record(
                    None if pd.isna(page) else int(page), url, html.encode("utf-8", "replace"),
                    None if pd.isna(first) else int(first), bool(revisit),
                ))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= roll:
                    out.close()
                    made.append((path, size, n))
                    out = None
        if out is not None:
            out.close()
            made.append((path, size, n))
        yield pd.DataFrame(made, columns=["path", "length", "n_records"])

    # ids as text: pandas would turn a column of longs with nulls into doubles
    cols = [F.col(c).cast("string").alias(c) for c in ("page_id", "first_id")]
    return cut(marked.select(*cols, "url", "html", "revisit").mapInPandas(write, "path string, length long, n_records long"))


class Source:
    """Bytes of a file from a position on, read in blocks."""

    def __init__(self, f, at: int):
        self.f, self.at, self.data = f, at, b""
        f.seek(at)

    def more(self) -> bool:
        block = self.f.read(BLOCK)
        self.data += block
        return bool(block)

    def drop(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def _starts_record(data: bytes) -> bool | None:
    """Whether a gzip member with a WARC header starts `data`; None if more bytes are needed to tell."""
    z = zlib.decompressobj(31)
    try:
        head = z.decompress(data, 1 << 16)
        if b"WARC/1."[: len(head)] != head[:7]:
            return False
        while b"\r\n\r\n" not in head and not z.eof and (more := z.decompress(z.unconsumed_tail, len(head))):
            head += more  # a header has no greatest length
    except zlib.error:
        return False
    if b"\r\n\r\n" in head:
        fields = head[: head.index(b"\r\n\r\n")]
        return b"WARC-Type:" in fields and b"Content-Length:" in fields
    return False if z.eof else None


def members(f, start: int, end: int) -> Iterator[bytes]:
    """The inflated records that start at `start` or later and before `end`."""
    src = Source(f, start)
    found = False
    while src.at < end:
        if not found:
            at = src.data.find(GZIP)
            if at < 0:
                src.drop(max(0, len(src.data) - 2))
                if not src.more():
                    return
                continue
            src.drop(at)
            if src.at >= end:
                return
            starts = _starts_record(src.data)
            if starts is None and src.more():
                continue
            if not starts:
                src.drop(1)
                continue
            found = True
        z, out = zlib.decompressobj(31), []
        data = src.data
        read = len(data)
        while True:
            out.append(z.decompress(data))
            if z.eof:
                break
            data = src.f.read(BLOCK)
            if not data:
                if read or out != [b""]:
                    raise ValueError(f"a record that starts at {src.at} is cut off")
                return
            read += len(data)
        rest = z.unused_data
        src.at += read - len(rest)
        src.data = rest
        yield b"".join(out)
        if not src.data and not src.more():
            return


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields in lower case, block) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[: int(fields["content-length"])]


def read_warc(files: DataFrame, split: int = 4 << 20, with_payload: bool = False) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of every record.

    `files` has path and length. The digest of a response is computed from the payload that was read and
    must equal its header's."""
    ranges = files.where("length > 0").select(
        "path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("start")
    )

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"]):
                rows = []
                with read_range(path) as f:
                    for data in members(f, int(start), int(start) + split):
                        rows.append(_row(data, with_payload))
                        if len(rows) >= 500:
                            yield _frame(rows, with_payload)
                            rows = []
                yield _frame(rows, with_payload)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    # a number of partitions that is given is not coalesced: a task for each range, or for a run of ranges beyond MOST_TASKS
    tasks = files.where("length > 0").agg(F.sum(F.ceil(F.col("length") / split))).first()[0] or 1
    return ranges.repartitionByRange(min(int(tasks), MOST_TASKS), "path", "start").mapInPandas(read, schema + ", payload binary" * with_payload)


def _row(data: bytes, with_payload: bool) -> tuple:
    fields, block = parsed(data)
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    length, payload = int(fields["payload-length"]), None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if digest32(payload) != digest:
            raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
        length = len(payload)
    whole = lambda k: int(fields[k]) if k in fields else None
    row = (whole("page-id"), fields.get("warc-target-uri"), length, digest, kind, whole("refers-to-page-id"))
    return (*row, payload) if with_payload else row


def _frame(rows: list[tuple], with_payload: bool) -> pd.DataFrame:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def round_trip(pages: DataFrame) -> DataFrame:
    """Every record read back; fails if their number is not the manifest's."""
    manifest = write_warc(pages, fresh_dir(pages.sparkSession, "warc"))
    read = stored(read_warc(manifest), "records")
    wrote = manifest.agg(F.coalesce(F.sum("n_records"), F.lit(0))).first()[0]
    if (found := read.count()) != wrote:
        raise ValueError(f"{wrote} records were written, {found} read back")
    return read
