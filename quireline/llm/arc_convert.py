"""Legacy archive converter: ARC files of version 1 and 2 to WARC 1.1.

``arc_records`` reads the version block, whose second line names the fields of every record's header line, then takes each record by its
declared length. ``convert`` turns a record into a WARC record with an identifier (a UUID from archive name and offset, so a repeated task
gives the same one), the 14-digit date as a WARC date, a type by its scheme and payload, and SHA-1 digests of block and payload. Records
with equal payloads become revisits of the one with the largest row id.

For a table of pages: ``write_arcs`` makes archives, ``scan_arcs`` reads digests from them, ``choose`` finds which record of equal payloads
stays, ``convert_arcs`` writes WARC files, and ``read_warcs`` reads those back. Only digests and places are shuffled, never payloads; equal
digests are counted before the shuffle, and the join that tells them apart is salted, so one payload may be a third of all rows. Files are
written to a shared folder under a temporary name and renamed.

A header line ends its URL at white space, so white space in a URL is written percent-encoded, and that is what the WARC record has. Null html
is an empty payload, a null url is written as ``-``. Rows with the same page_id and payload: one of them is the response. A null
page_id is smaller than any other. Other columns are not looked at. Empty tables give no rows. A record cut off before its declared length raises ``ValueError``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireline.llm.storage import filesystem, new_folder, publish, small_batches, written

FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
SALTS = 16
#: Payload bytes after which a task begins its next archive.
ROLL_BYTES = 64 << 20
_NAMESPACE = uuid.UUID("5f1e8a1c-35a8-5c0b-9d0b-6d2f6d0a6d11")
_ROW, _REFERS_ROW = "X-Source-Row", "WARC-X-Refers-To-Source-Row"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class Pieces(io.RawIOBase):
    """Gzip members of one record each, which together are the file."""

    def __init__(self, out, level: int = 1):
        self.out, self.level, self.at = out, level, 0

    def record(self, data: bytes) -> int:
        packed = gzip.compress(data, self.level, mtime=0)
        self.out.write(packed)
        self.at += len(packed)
        return self.at - len(packed)


def arc_version_block(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 quireline\n{' '.join(FIELDS[version])}\n\n".encode()
    rest = [str(len(body))] if version == 1 else ["200", "-", "-", "0", name, str(len(body))]
    return " ".join([f"filedesc://{name}", "0.0.0.0", date, "text/plain", *rest]).encode() + b"\n" + body


def arc_record(url: str, date: str, kind: str, body: bytes, *, version: int = 1, name: str = "-", offset: int = 0, ip: str = "0.0.0.0") -> bytes:
    safe = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "-"
    rest = [str(len(body))] if version == 1 else ["200", sha1_base32(body), "-", str(offset), name, str(len(body))]
    return b"\n" + " ".join([safe, ip, date, kind, *rest]).encode() + b"\n" + body


def arc_records(source) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(header fields, body, record number) of all records after the version block; ``source`` is a binary stream, plain or already inflated."""
    line = source.readline()
    if not line.startswith(b"filedesc://"):
        raise ValueError("no version block")
    head = line.decode("utf-8", "replace").split()
    block = source.read(int(head[-1])).decode("utf-8", "replace").splitlines()
    version = int(block[0].split()[0])
    fields = block[1].split() if len(block) > 1 else FIELDS[version]
    if version not in FIELDS or len(fields) != len(FIELDS[version]):
        raise ValueError(f"unknown version {version}")
    number = 0
    while True:
        line = source.readline()
        while line in (b"\n", b"\r\n"):
            line = source.readline()
        if not line:
            return
        # only the URL can hold blanks, so fields are counted from the right
        values = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(fields) - 1)
        if len(values) != len(fields) or not values[-1].isdigit():
            raise ValueError(f"header line {line[:80]!r}")
        size = int(values[-1])
        body = source.read(size)
        if len(body) != size:
            raise ValueError("record cut off before its declared length")
        yield dict(zip(fields, values, strict=True)), body, number
        number += 1


def http_parts(body: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """(header block with its blank line, headers in lower case, payload) of an HTTP response; no headers if it is none."""
    if not body.startswith(b"HTTP/"):
        return b"", {}, body
    end = re.search(rb"\r?\n\r?\n", body)
    cut = end.end() if end else len(body)
    headers = {}
    for line in body[:cut].decode("latin-1").splitlines()[1:]:
        name, colon, value = line.partition(":")
        if colon:
            headers[name.strip().lower()] = value.strip()
    return body[:cut], headers, body[cut:]


def warc_date(date: str) -> str:
    """14 digits (shorter ones are filled up) as a WARC date; 1970 where they are none."""
    digits = re.sub(r"\D", "", date)[:14]
    digits += "19700101000000"[len(digits) :]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def record_id(archive: str, number: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{archive}#{number}')}>"


def warc_bytes(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def convert(head: dict[str, str], body: bytes, archive: str, number: int, refers: dict | None = None) -> bytes:
    """The WARC record of an ARC record. ``refers``: id, url, date and row of the record that has the same payload."""
    url, (header, _, payload) = head["URL"], http_parts(body)
    fields = [("WARC-Record-ID", record_id(archive, number)), ("WARC-Date", warc_date(head["Archive-date"])), ("WARC-Target-URI", url), ("WARC-IP-Address", head["IP-address"]), ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}")]
    if header:
        block = header if refers else body
        kind, media = ("revisit" if refers else "response"), "application/http; msgtype=response"
    else:
        block, kind, media = body, "resource", head["Content-type"]
    if refers and header:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers["id"]), ("WARC-Refers-To-Target-URI", refers["url"]), ("WARC-Refers-To-Date", refers["date"])]
        if refers.get("row") is not None:
            fields.append((_REFERS_ROW, str(refers["row"])))
    return warc_bytes(kind, [*fields, ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Type", media)], block)


def warc_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record."""
    while True:
        line = source.readline()
        while line == b"\r\n":
            line = source.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"record begins with {line[:40]!r}")
        head = {}
        while (line := source.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            head[name.strip()] = value.strip()
        size = int(head["Content-Length"])
        block = source.read(size)
        if len(block) != size:
            raise ValueError("record cut off")
        yield head, block


def _page_date(number) -> str:
    """Pages have no date; each gets one second of a fixed day."""
    n = abs(number or 0) % 86400
    return f"20000101{n // 3600:02d}{n // 60 % 60:02d}{n % 60:02d}"


def write_arcs(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", version: int = 1, folder: str | None = None) -> DataFrame:
    """Archives with a record for each page. Per archive: path, n_records."""
    small_batches(pages.sparkSession)
    folder = folder or new_folder(pages.sparkSession, "arc")
    held = pages.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(url, F.lit("-")).alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(folder)
        task, done, current = TaskContext.get().partitionId(), [], None

        def close():
            current[1].close()
            publish(files, current[2], f"{root}/{current[0]}")
            done.append((f"{folder}/{current[0]}", current[4]))

        for batch in batches:
            for page, address, payload in zip(*(batch.column(n).to_pylist() for n in ("page_id", "url", "html")), strict=True):
                if current is not None and current[5] >= ROLL_BYTES:
                    close()
                    current = None
                if current is None:
                    name = f"pages-{task:06d}-{len(done):04d}.arc.gz"
                    files.create_dir(root, recursive=True)
                    temp = f"{root}/.{name}-{uuid.uuid4().hex}"
                    out = files.open_output_stream(temp, compression=None)
                    current = [name, out, temp, Pieces(out), 0, 0]
                    current[3].record(arc_version_block(name, version, "20000101000000"))
                row = "" if page is None else f"{_ROW}: {page}\r\n"
                body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{row}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                current[3].record(arc_record(address, _page_date(page), "text/html", body, version=version, name=current[0], offset=current[3].at))
                current[4] += 1
                current[5] += len(body)
        if current is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "n_records": [d[1] for d in done]}, pa.schema([("path", pa.string()), ("n_records", pa.int64())]))

    return written(held.mapInArrow(run, "path string, n_records long"), "arc-list")


def _spread(files: DataFrame) -> DataFrame:
    return files.repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _open(path: str):
    files, place = filesystem(path)
    return gzip.GzipFile(fileobj=io.BufferedReader(files.open_input_stream(place, compression=None), 1 << 20)) if path.endswith(".gz") else files.open_input_stream(place, compression=None)


def scan_arcs(archives: DataFrame) -> DataFrame:
    """Per ARC record: path, number, url, date, page_id, payload_bytes, payload_digest."""
    kinds = [("path", pa.string()), ("number", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with _open(path) as source:
                    for head, body, number in arc_records(source):
                        _, headers, payload = http_parts(body)
                        row = headers.get(_ROW.lower())
                        rows.append((path, number, head["URL"], head["Archive-date"], None if row is None else int(row), len(payload), sha1_base32(payload)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])

    return written(_spread(archives).mapInArrow(run, "path string, number long, url string, date string, page_id long, payload_bytes long, payload_digest string"), "arc-records")


def choose(records: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """``records`` with ``first``: the record of an equal payload that stays (null for itself, for lone payloads and for those under ``least_bytes``)."""
    me = F.struct("page_id", "path", "number", "url", "date")
    groups = records.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max(me).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = records.withColumn("salt", F.pmod(F.hash("path", "number"), F.lit(SALTS))).join(salted, ["payload_digest", "payload_bytes", "salt"], "left").drop("salt")
    itself = (F.col("first.path") == F.col("path")) & (F.col("first.number") == F.col("number"))
    return joined.withColumn("first", F.when(~itself, F.col("first")))


def convert_arcs(chosen: DataFrame, *, folder: str | None = None) -> DataFrame:
    """A WARC file for each archive. Per file: path, n_records. ``chosen`` has the rows of ``choose``."""
    folder = folder or new_folder(chosen.sparkSession, "warc")
    held = chosen.select("path", "number", F.col("first.page_id").alias("row"), F.col("first.path").alias("first_path"), F.col("first.number").alias("first_number"), F.col("first.url").alias("first_url"), F.col("first.date").alias("first_date"))

    def run(own):
        import pandas as pd

        path = own["path"].iloc[0]
        archive = path.rpartition("/")[2]
        refers = {}
        for r in own[own["first_path"].notna()].itertuples(index=False):
            refers[int(r.number)] = {"id": record_id(r.first_path.rpartition("/")[2], int(r.first_number)), "url": r.first_url, "date": warc_date(r.first_date), "row": None if pd.isna(r.row) else int(r.row)}
        name = re.sub(r"\.arc(\.gz)?$", "", archive) + ".warc.gz"
        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        temp, n = f"{root}/.{name}-{uuid.uuid4().hex}", 0
        with files.open_output_stream(temp, compression=None) as out:
            pieces = Pieces(out)
            info = b"software: quireline\r\nformat: WARC File Format 1.1\r\n"
            pieces.record(warc_bytes("warcinfo", [("WARC-Record-ID", record_id(archive, -1)), ("WARC-Date", warc_date("20000101")), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info))
            with _open(path) as source:
                for head, body, number in arc_records(source):
                    pieces.record(convert(head, body, archive, number, refers.get(number)))
                    n += 1
        publish(files, temp, f"{root}/{name}")
        return pd.DataFrame({"path": [f"{folder}/{name}"], "n_records": [n]})

    # a given number of tasks: the rows are few, the archives behind them are not
    dealt = held.repartition(max(1, int(chosen.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")
    return written(dealt.groupBy("path").applyInPandas(run, "path string, n_records long"), "warc-list")


def read_warcs(archives: DataFrame) -> DataFrame:
    """Per response, revisit or resource: page_id, payload_bytes, payload_digest, record_type, refers_to, and record_id, date, url."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "date", "url"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with _open(path) as source:
                    for head, block in warc_records(source):
                        if head["WARC-Type"] not in ("response", "revisit", "resource"):
                            continue
                        if head["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}":
                            raise ValueError(f"block digest of {head['WARC-Record-ID']}")
                        _, headers, payload = http_parts(block)
                        revisit, row, refers = head["WARC-Type"] == "revisit", headers.get(_ROW.lower()), head.get(_REFERS_ROW)
                        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if not revisit and digest != sha1_base32(payload):
                            raise ValueError(f"payload digest of {head['WARC-Record-ID']}")
                        rows.append((row and int(row), int(headers["content-length"]) if revisit else len(payload), digest, head["WARC-Type"], refers and int(refers), head["WARC-Record-ID"], head["WARC-Date"], head["WARC-Target-URI"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return _spread(archives).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, date string, url string")
