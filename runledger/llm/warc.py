"""Operator 9, WARC records in ZIP packages, read by ranges.

Writing: rows are streamed into packages of about ``PACKAGE`` bytes, ZIP files with two
stored members: ``archive/data.warc.gz`` (one gzip member for each record) and
``indexes/index.cdxj`` (a line with offset and length of each record). Of records with equal payloads of at least
``least`` bytes the one with the largest id is a response and the others revisit it.
A task names its files by a random key and returns what it wrote; only the lists
of tasks that Spark committed are kept, so a repeated task leaves files that nobody reads.

Reading: the end of a package gives its central directory (ZIP64 records where the plain
fields are full), that the places of the stored members, and the index those of the records.
Runs of records next to each other are dealt out anew and read by their byte range;
no member is extracted.

Files are reached with pyarrow's file systems (file:, hdfs:, s3:, gs:) below the
folder given, which must be one that all executors share.

Null payloads are empty. Rows whose id is null never are the response of rows with an id; equal rows
are all responses if their id is the largest. Empty tables give no packages and no rows;
extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import stored
from runledger.session import shared_dir

#: Bytes of one package before it is closed, of one range read, and the payloads that may be revisited.
PACKAGE, RUN, LEAST = 16 << 20, 2 << 20, 1000
#: Runs that one reading task gets on average.
TASK_RUNS = 8
# Signatures of the ZIP format.
LOCAL, CENTRAL, EOCD, EOCD64, LOCATOR = (struct.pack("<I", s) for s in (0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50))
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def zip_package(members: list[tuple[str, bytes]], wide: bool = True) -> bytes:
    """A ZIP file of stored members; ``wide`` writes sizes and places in ZIP64 records, as packages over 4 GB need."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        at, n, crc, title = len(out), len(data), zlib.crc32(data), name.encode()
        extra = struct.pack("<HHQQ", 1, 16, n, n) if wide else b""
        version, shown = (45, FULL32) if wide else (20, n)
        out += LOCAL + struct.pack("<HHHHHIIIHH", version, 0x800, 0, 0, 33, crc, shown, shown, len(title), len(extra)) + title + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if wide else b""
        central += CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", version, version, 0x800, 0, 0, 33, crc, shown, shown, len(title),
                                         len(extra), 0, 0, 0, 0, FULL32 if wide else at) + title + extra
    at, size, count = len(out), len(central), len(members)
    out += central
    if wide:
        out += EOCD64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, size, at)
        out += LOCATOR + struct.pack("<IQI", 0, at + size, 1)
    out += EOCD + struct.pack("<HHHHIIH", 0, 0, *([FULL16] * 2 if wide else [count] * 2), *([FULL32] * 2 if wide else [size, at]), 0)
    return bytes(out)


def central_directory(file) -> dict[str, tuple[int, int, int]]:
    """(method, place of the data, size) of each member of an open package."""
    size = file.size()
    tail_at = max(0, size - (1 << 16) - 22)
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(EOCD)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, at = struct.unpack("<HII", tail[end + 10:end + 20])
    if FULL16 == count or FULL32 in (length, at):
        if tail[end - 20:end - 16] == LOCATOR:
            wide = file.read_at(56, struct.unpack("<Q", tail[end - 12:end - 4])[0])
            if wide[:4] != EOCD64:
                raise ValueError("no ZIP64 end of central directory")
            count, length, at = struct.unpack("<QQQ", wide[32:56])
    directory, found, here = file.read_at(length, at), {}, 0
    for _ in range(count):
        if directory[here:here + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, packed, full, name, extra, comment = struct.unpack("<H8xIIHHH", directory[here + 10:here + 34])
        place = struct.unpack("<I", directory[here + 42:here + 46])[0]
        title = directory[here + 46:here + 46 + name].decode()
        more, k = directory[here + 46 + name:here + 46 + name + extra], 0
        while k + 4 <= len(more):
            kind, n = struct.unpack("<HH", more[k:k + 4])
            if kind == 1:
                wide, j = more[k + 4:k + 4 + n], 0
                if full == FULL32:
                    full, j = struct.unpack("<Q", wide[j:j + 8])[0], j + 8
                if packed == FULL32:
                    packed, j = struct.unpack("<Q", wide[j:j + 8])[0], j + 8
                if place == FULL32:
                    place = struct.unpack("<Q", wide[j:j + 8])[0]
            k += 4 + n
        head = file.read_at(30, place)
        if head[:4] != LOCAL:
            raise ValueError("no local header")
        found[title] = (method, place + 30 + sum(struct.unpack("<HH", head[26:30])), packed)
        here += 46 + name + extra + comment
    return found


def _record(id, payload: bytes, digest: str, refers_to) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "1970-01-01T00:00:00Z",
            "WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": len(payload), "X-Id": json.dumps(id)}
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To": json.dumps(refers_to)}
    head |= {"Content-Type": "text/html", "Content-Length": len(body)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    return fields, rest[:int(fields["Content-Length"])]


def _written(folder: str, records: list[bytes]) -> str:
    place, lines, at = f"{folder}/{uuid.uuid4().hex}.wacz", [], 0
    for data in records:
        lines.append(json.dumps({"offset": at, "length": len(data)}))
        at += len(data)
    store, path = fs.FileSystem.from_uri(place if ":" in place.split("/")[0] else f"file://{place}")
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(zip_package([("archive/data.warc.gz", b"".join(records)), ("indexes/index.cdxj", "\n".join(lines).encode())]))
    return place


def write_packages(pages: DataFrame, folder: str, least: int = LEAST, id: str = "page_id", payload: str = "html") -> DataFrame:
    """Write the archives below ``folder``; returns ``path`` and ``records`` of each package.

    Ids are integers or texts; a null column ``id`` of their type tells the reader which.
    """
    rows = pages.select(F.col(id).alias("id"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    keyed = rows.select("id", "payload", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    slim = keyed.where(F.col("bytes") >= least).select("id", "digest", "bytes")
    # Only payloads that occur again travel: one row for each of them.
    again = stored(slim.groupBy("digest", "bytes").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "revisited")
    marked = keyed.join(again, ["digest", "bytes"], "left").select(
        "id", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches):
        records, held = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                records.append(gzip.compress(_record(*row), 1, mtime=0))
                held += len(records[-1])
                if held >= PACKAGE:
                    yield pa.RecordBatch.from_arrays([pa.array([_written(folder, records)]), pa.array([len(records)], pa.int64())], ["path", "records"])
                    records, held = [], 0
        if records:
            yield pa.RecordBatch.from_arrays([pa.array([_written(folder, records)]), pa.array([len(records)], pa.int64())], ["path", "records"])

    made = marked.mapInArrow(run, "path string, records long")
    return stored(made.withColumn("id", F.lit(None).cast(pages.schema[id].dataType)), "packages")


def _open(path: str):
    store, inner = fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")
    return store.open_input_file(inner)


def record_runs(packages: DataFrame) -> DataFrame:
    """``path``, ``at`` and ``lengths`` of runs of about ``RUN`` bytes of records, from each package's index."""
    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _open(path) as file:
                    members = central_directory(file)
                    data, index = (next(m for name, m in members.items() if name.startswith(x)) for x in ("archive/", "indexes/"))
                    if data[0] or index[0]:
                        raise ValueError(f"{path}: members must be stored")
                    lines = [json.loads(x) for x in file.read_at(index[2], index[1]).splitlines()]
                runs, held = [], RUN
                for line in lines:
                    if held >= RUN:
                        runs.append((data[1] + line["offset"], []))
                        held = 0
                    runs[-1][1].append(line["length"])
                    held += line["length"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(runs), pa.string()), pa.array([r[0] for r in runs], pa.int64()),
                     pa.array([r[1] for r in runs], pa.list_(pa.int64()))], ["path", "at", "lengths"])

    return packages.select("path").mapInArrow(run, "path string, at long, lengths array<long>")


def read_packages(packages: DataFrame, id_type: str | None = None) -> DataFrame:
    """``id``, ``type``, ``refers_to``, ``payload`` (null for revisits), ``payload_bytes`` and ``digest`` of each record.

    Ids have the type of the column ``id`` of ``packages``; a list of paths without it names
    ``id_type``. A task reads about ``TASK_RUNS`` runs, however small the rows that name them.
    Size and digest of a response are taken from the payload read, those of a revisit from its header.
    """
    id_type = id_type or packages.schema["id"].dataType.simpleString()
    integers = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "long": pa.int64(), "bigint": pa.int64()}
    kind = integers.get(id_type, pa.string())

    def run(batches):
        for batch in batches:
            for path, at, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                with _open(path) as file:
                    data = file.read_at(sum(lengths), at)
                here, out = 0, []
                for n in lengths:
                    head, body = parse_record(gzip.decompress(data[here:here + n]))
                    here += n
                    full = head["WARC-Type"] == "response"
                    out.append((json.loads(head["X-Id"]), head["WARC-Type"], json.loads(head.get("X-Refers-To", "null")), body if full else None,
                                len(body) if full else int(head["X-Payload-Length"]),
                                hashlib.sha1(body).hexdigest() if full else head["WARC-Payload-Digest"].partition(":")[2]))
                columns = zip(*out)
                types = (None, pa.string(), None, pa.binary(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t or kind) for c, t in zip(columns, types)],
                                                 ["id", "type", "refers_to", "payload", "payload_bytes", "digest"])

    runs = stored(record_runs(packages), "record_runs")
    return runs.repartition(max(1, -(-runs.count() // TASK_RUNS)), F.xxhash64("path", "at")).mapInArrow(
        run, f"id {id_type}, type string, refers_to {id_type}, payload binary, payload_bytes long, digest string")


def archive_folder(spark) -> str:
    """A fresh folder for packages in the shared place of the session."""
    return shared_dir(spark, "packages")
