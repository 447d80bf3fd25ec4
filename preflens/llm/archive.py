"""Legacy archive conversion: ARC files (versions 1 and 2) into WARC files with equivalent records.

An ARC file starts with a version block that names the fields of its URL-record lines; each record is such a line, whose last
field declares the length of the block, and the block. The converter streams a file, cuts records by their declared lengths
and synthesises what WARC needs: record ids (named from the file and the offset, so a repeated task writes the same file),
UTC timestamps from the 14-digit dates, record types and SHA-1 digests.

Archives live in a folder that all executors share. One task handles one file, record by record. Whether a record is a
response or revisits an equal payload is decided by a Spark aggregation over digests; payloads never pass a shuffle.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preflens.llm.store import keep, new_path

FILE_BYTES = 64 << 20
LEVEL = 6
#: The field lists of the two ARC versions and the WARC revisit profile.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = re.compile(r"\s+")


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_shared(uri: str, mode: str):
    files, path = arrow_fs.FileSystem.from_uri(uri)
    if mode == "r":
        return files.open_input_stream(path, compression=None)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return files.open_output_stream(path, compression=None)


def finish(temporary: str, uri: str) -> None:
    """Give a written file its name; a second attempt of the task replaces it by the same bytes."""
    files, path = arrow_fs.FileSystem.from_uri(temporary)
    files.move(path, arrow_fs.FileSystem.from_uri(uri)[1])


def member(data: bytes) -> bytes:
    return gzip.compress(data, LEVEL, mtime=0)


# ---------------------------------------------------------------- ARC


def arc_version_block(name: str, version: int) -> bytes:
    body = f"{version} 0 preflens\n{ARC_FIELDS[version]}\n".encode()
    fields = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": "19960101000000", "Content-type": "text/plain", "Result-code": "200",
              "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(fields[f] for f in ARC_FIELDS[version].split()).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str, date: str, mime: str, block: bytes, name: str = "-", offset: int = 0) -> bytes:
    fields = {"URL": _SPACE.sub("%20", url) or "-", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": mime or "no-type", "Result-code": "200",
              "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(block))}
    return " ".join(fields[f] for f in ARC_FIELDS[version].split()).encode() + b"\n" + block + b"\n"


def read_exact(stream: BinaryIO, n: int) -> bytes:
    data = stream.read(n)
    while len(data) < n:
        more = stream.read(n - len(data))
        if not more:
            raise ValueError("the archive ends inside a record")
        data += more
    return data


def read_arc(stream: BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields by name, block) of each record of an uncompressed ARC stream.

    The version block tells the fields; a line with fewer fields than that is read from both ends, as in version 1.
    """
    offset, names = 0, ARC_FIELDS[1].split()
    while line := stream.readline():
        start, offset = offset, offset + len(line)
        if not line.strip():
            continue
        values = line.decode("utf-8", "surrogateescape").rstrip("\r\n").split(" ")
        if len(values) < 5:
            raise ValueError(f"no ARC header at {start}")
        block = read_exact(stream, int(values[-1]))
        offset += len(block)
        if values[0].startswith("filedesc:"):
            lines = block.decode("utf-8", "replace").split("\n")
            names = lines[1].split() if len(lines) > 1 and lines[1].strip() else ARC_FIELDS[int(lines[0].split()[0])].split()
            continue
        extra = len(values) - len(names)
        if extra < 0:
            fields = dict(zip(ARC_FIELDS[1].split(), [*values[:4], values[-1]], strict=True))
        else:  # blanks inside a URL
            fields = dict(zip(names, [" ".join(values[:extra + 1]), *values[extra + 1:]], strict=True))
        yield start, fields, block


def write_arc(df: DataFrame, folder: str, id_col: str, url_col: str, payload_col: str, date: str = "20080430204825", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a response record per row into gzipped ARC files, both versions in turn; returns (file, records).

    The HTTP header of a record holds the row's id (none if it is null) and its payload length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, out, done = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            for key, url, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    version, name = 1 + (part + number) % 2, f"{part:06d}-{number:04d}.arc.gz"
                    temporary = f"{folder}/.{name}-{uuid.uuid4().hex}"
                    out, size, records = open_shared(temporary, "w"), 0, 0
                    out.write(member(arc_version_block(name, version)))
                payload = (text or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
                head += f"X-Row-Id: {key}\r\n\r\n" if key is not None else "\r\n"
                data = member(arc_record(version, url or "", date, "text/html", head.encode() + payload, name, size))
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= file_bytes:
                    out.close()
                    finish(temporary, f"{folder}/{name}")
                    done.append((f"{folder}/{name}", records))
                    out, number = None, number + 1
        if out is not None:
            out.close()
            finish(temporary, f"{folder}/{name}")
            done.append((f"{folder}/{name}", records))
        yield pa.RecordBatch.from_pylist([{"file": f, "records": n} for f, n in done], pa.schema([("file", pa.string()), ("records", pa.int64())]))

    return df.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(payload_col).cast("string")).mapInArrow(run, "file string, records long")


def http_parts(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """(header bytes, fields in lower case, payload) of an HTTP response; a block without such a header is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", {}, block
    head, mark, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
    return head + mark, {k.lower(): v for k, v in fields.items()}, payload


def arc_index(files: DataFrame) -> DataFrame:
    """(file, offset, row_id, payload_bytes, payload_digest) of every record of the ARC files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file in batch["file"]:
                rows = []
                for offset, _, block in read_arc(gzip.GzipFile(fileobj=io.BufferedReader(open_shared(file, "r"), 1 << 20))):
                    _, fields, payload = http_parts(block)
                    rows.append((file, offset, int(fields["x-row-id"]) if "x-row-id" in fields else None, len(payload), sha1(payload)))
                    if len(rows) == 10_000:
                        yield index_frame(rows)
                        rows = []
                yield index_frame(rows)

    return files.select("file").mapInPandas(run, "file string, offset long, row_id long, payload_bytes long, payload_digest string")


def index_frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["file", "offset", "row_id", "payload_bytes", "payload_digest"])
    frame["row_id"] = frame["row_id"].astype("Int64")
    return frame


def decide(index: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds ``original`` to each record that revisits: (row_id, file, offset) of the response with an equal payload.

    Equal payloads of ``least_bytes`` or more keep the record of smallest row id (null last; ties by file and offset).
    The minimum is combined before the shuffle, so a payload that a third of all rows share is one row for each task.
    """
    place = F.struct(F.col("row_id").isNull().alias("none"), "row_id", "file", "offset")
    first = index.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.filter("n > 1").drop("n")
    both = index.join(first, ["payload_digest", "payload_bytes"], "left")
    itself = (F.col("first.file") == F.col("file")) & (F.col("first.offset") == F.col("offset"))
    return both.select(*index.columns, F.when(~itself, F.struct("first.row_id", "first.file", "first.offset")).alias("original"))


# ---------------------------------------------------------------- WARC


def record_id(file: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file.rsplit("/", 1)[-1]}#{offset}')}>"


def warc_date(arc_date: str) -> str:
    """ISO time of a 14-digit (or shorter, as 8 or 12 digits) ARC date."""
    digits = (re.sub(r"\D", "", arc_date) + "00000101000000"[len(re.sub(r"\D", "", arc_date)):])[:14]
    return datetime.strptime(digits, "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + block + b"\r\n\r\n"


def convert_record(file: str, offset: int, fields: dict[str, str], block: bytes, digest: str, original: dict | None) -> bytes:
    """The WARC record that stands for an ARC record."""
    head, _, _ = http_parts(block)
    kind = "revisit" if original else "response" if head else "resource"
    url = fields["URL"]
    if not re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", url):
        url = f"urn:x-arc:{url}"
    out = [("WARC-Type", kind), ("WARC-Record-ID", record_id(file, offset)), ("WARC-Date", warc_date(fields["Archive-date"])), ("WARC-Target-URI", url)]
    if fields.get("IP-address", "0.0.0.0") not in ("0.0.0.0", "-"):
        out.append(("WARC-IP-Address", fields["IP-address"]))
    out.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if original:
        out += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(original["file"], original["offset"]))]
        if original["row_id"] is not None:
            out.append(("X-Refers-To-Row", original["row_id"]))
        block = head
    out.append(("WARC-Block-Digest", f"sha1:{sha1(block)}"))
    out.append(("Content-Type", "application/http; msgtype=response" if head else fields.get("Content-type", "application/octet-stream")))
    return warc_record(out, block)


def convert_files(decisions: DataFrame, folder: str) -> DataFrame:
    """Convert each ARC file into a WARC file; the decisions of one file's records meet in its task. Returns (file, records)."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        file = rows["file"].iloc[0]
        known = {
            o: (d, {"row_id": r, "file": f, "offset": int(at)} if f is not None else None)
            for o, d, r, f, at in zip(*(rows[c] for c in rows.columns if c != "file"), strict=True)
        }
        name = file.rsplit("/", 1)[-1].replace(".arc", ".warc")
        temporary = f"{folder}/.{name}-{uuid.uuid4().hex}"
        out, n = open_shared(temporary, "w"), 0
        info = f"software: preflens\r\nformat: WARC File Format 1.1\r\ndescription: converted from {file.rsplit('/', 1)[-1]}\r\n".encode()
        out.write(member(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(file, -1)), ("WARC-Date", warc_date("19960101")),
                                      ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info)))
        for offset, fields, block in read_arc(gzip.GzipFile(fileobj=io.BufferedReader(open_shared(file, "r"), 1 << 20))):
            digest, original = known[offset]
            out.write(member(convert_record(file, offset, fields, block, digest, original)))
            n += 1
        out.close()
        finish(temporary, f"{folder}/{name}")
        return pd.DataFrame({"file": [f"{folder}/{name}"], "records": [n]})

    first = [F.col(f"original.{c}").cast("string").alias(f"first_{c}") for c in ("row_id", "file", "offset")]
    return decisions.select("file", "offset", "payload_digest", *first).groupBy("file").applyInPandas(one, "file string, records long")


def read_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of each record of an uncompressed WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            fields[name.lower()] = value.strip()
        yield fields, read_exact(stream, int(fields["content-length"]))


def warc_rows(files: DataFrame) -> DataFrame:
    """(row_id, payload_bytes, payload_digest, record_type, refers_to, url, record_id) of the response and revisit records.

    Digests are checked against the blocks; a revisit tells the length and digest of the payload that it stands for.
    """
    names = ["row_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows):
            out = pd.DataFrame(rows, columns=names)
            return out.assign(row_id=out["row_id"].astype("Int64"), refers_to=out["refers_to"].astype("Int64"))

        for batch in batches:
            for file in batch["file"]:
                rows = []
                for fields, block in read_warc(gzip.GzipFile(fileobj=io.BufferedReader(open_shared(file, "r"), 1 << 20))):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    _, http, payload = http_parts(block)
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    revisit = fields["warc-type"] == "revisit"
                    if not revisit and digest != sha1(payload) or fields["warc-block-digest"] != f"sha1:{sha1(block)}":
                        raise ValueError(f"digest of {fields['warc-record-id']} in {file}")
                    rows.append((int(http["x-row-id"]) if "x-row-id" in http else None, int(http["content-length"]) if revisit else len(payload), digest,
                                 fields["warc-type"], int(fields["x-refers-to-row"]) if "x-refers-to-row" in fields else None, fields["warc-target-uri"], fields["warc-record-id"]))
                    if len(rows) == 10_000:
                        yield frame(rows)
                        rows = []
                yield frame(rows)

    return files.select("file").mapInPandas(run, "row_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string")


def one_task_each(files: DataFrame) -> DataFrame:
    """Deal the file names out so that each task handles a few files; there is one row for each file."""
    n = max(1, files.count())
    return files.repartition(min(n, 4 * files.sparkSession.sparkContext.defaultParallelism) if n < 10_000 else n // 4)


def archive(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write rows as ARC records, convert the ARC files to WARC, and read the WARC files back.

    Returns id, payload_bytes, payload_digest, record_type (response or revisit), refers_to (id of the response), url and
    record_id. Null payloads are empty, null URLs become ``urn:x-arc:-``, rows with a null id stay (a revisit of such a row
    refers to null), repeated rows revisit the first of them, an empty table gives none; other columns are left aside.
    """
    spark = df.sparkSession
    folder = folder or new_path(spark, "archives")
    arcs = keep(write_arc(df, f"{folder}/arc", id_col, url_col, payload_col), "arc-files")
    index = keep(arc_index(one_task_each(arcs)), "arc-index")
    warcs = keep(convert_files(decide(index, least_bytes), f"{folder}/warc"), "warc-files")
    rows = warc_rows(one_task_each(warcs))
    return rows.withColumn("row_id", F.col("row_id").cast(df.schema[id_col].dataType)).withColumnRenamed("row_id", id_col)
