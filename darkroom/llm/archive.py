"""Artifacts in WARC archives: indexed as they are written, read back by coalesced byte ranges."""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkroom.llm.runs import exact_copies
from darkroom.session import cut_lineage, scratch_dir

#: Payloads below this size are never written as a revisit.
LEAST_BYTES = 1000
#: An archive file is closed at this size; a read is extended over gaps up to the second number.
FILE_BYTES, GAP_BYTES, READ_BYTES = 32 << 20, 64 << 10, 8 << 20


def _index(kind: str) -> str:
    return (
        f"id {kind}, archive string, offset long, length long, location string, payload_digest string, "
        f"payload_bytes long, record_type string, refers_to {kind}"
    )


def _recorded(kind: str) -> str:
    return (
        f"id {kind}, location string, record_type string, refers_to {kind}, payload_digest string, "
        "payload_bytes long, payload binary"
    )


def _uri(path: str) -> str:
    """``file:/x`` and ``/x`` as ``file:///x``; other schemes as they are."""
    return path if "://" in path else "file://" + path.removeprefix("file:")


def _record(name, date, id, location, payload, digest, kind, refers_to, original) -> bytes:
    full = len(payload)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}",
        "WARC-Target-URI: " + (location or "").replace("\r", " ").replace("\n", " "),
        f"WARC-Payload-Digest: sha1:{digest}", f"Artifact-ID: {json.dumps(id)}", f"Artifact-Payload-Length: {full}",
        "Content-Type: application/http;msgtype=response",
    ]
    if kind == "revisit":
        head += [
            f"WARC-Refers-To: <urn:uuid:{original}>", f"Artifact-Refers-To: {json.dumps(refers_to)}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {full}\r\n\r\n".encode()
    block += b"" if kind == "revisit" else payload
    body = "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)  # a gzip member of its own, so that it can be read alone
    return packer.compress(body) + packer.flush()


def _parse(raw: bytes) -> tuple:
    body = zlib.decompress(raw, 31)
    head, _, rest = body.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    kind = fields["WARC-Type"]
    payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")[2] if kind == "response" else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(fields["Artifact-Payload-Length"])
    if payload is not None and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not hold what its index says")
    refers_to = json.loads(fields.get("Artifact-Refers-To", "null"))
    return json.loads(fields["Artifact-ID"]), fields["WARC-Target-URI"], kind, refers_to, digest, size, payload


def _decided(staged: DataFrame, least_bytes: int) -> str:
    """A folder of (row, keep_id, keep_row), by slice of ``staged``, for every row that revisits another.

    Only digests, ids and row numbers meet here; the bodies stay where they are.
    """
    narrow = staged.where(F.col("size") >= least_bytes).select(F.struct("id", "row").alias("key"), "witness")
    copies = exact_copies(narrow, "key", "witness").where("group_size > 1")
    away = copies.where(~F.col("id.id").eqNullSafe(F.col("keep_id.id"))).select(
        F.shiftright("id.row", 33).alias("part"), F.col("id.row").alias("row"),
        F.col("keep_id.id").alias("keep_id"), F.col("keep_id.row").alias("keep_row"),
    )
    folder = scratch_dir(staged.sparkSession, "revisits")
    away.repartition("part").write.partitionBy("part").parquet(folder)
    return folder


def _revisits(folder: str, part: int) -> dict:
    """What ``_decided`` says of one slice: at most as many entries as the slice has rows."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(_uri(folder))
    found = {}
    for info in system.get_file_info(fs.FileSelector(f"{base}/part={part}", allow_not_found=True)):
        if info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as file:
                rows = pq.read_table(file).to_pydict()
            found.update(zip(rows["row"], zip(rows["keep_id"], rows["keep_row"], strict=True), strict=True))
    return found


def write_archives(
    artifacts: DataFrame, path: str, id: str = "id", location: str = "location", body: str = "body",
    least_bytes: int = LEAST_BYTES,
) -> DataFrame:
    """Write one WARC record per artifact below ``path``, a folder all executors share; return the index.

    The project's artifacts are named by id and content; where one was served from is its
    ``location``. Of artifacts with equal bodies of at least ``least_bytes`` bytes the one with the
    largest id is a response and the others revisit it; all smaller ones are responses. A row that
    repeats the surviving one, id included, is a response too.

    Index columns: ``id, archive, offset, length, location, payload_digest, payload_bytes,
    record_type, refers_to``; ids are integers or texts and keep their type. Every record has a name
    and the date of this call. A task writes files of its own name for every attempt, and only the
    files of attempts that succeeded are in the index. A null body is empty; a null location is an
    empty one; null ids stay null. An empty table has an empty index.

    Bodies are staged once, so that their rows have numbers; which rows revisit others is decided on
    digests and read back by slice and row number, so bodies are never shuffled.
    """
    kind_of = artifacts.schema[id].dataType.simpleString()
    if kind_of not in ("string", "bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"ids must be integers or texts, not {kind_of}")
    staged = cut_lineage(artifacts.select(
        F.col(id).alias("id"), F.col(location).cast("string").alias("location"),
        F.coalesce(F.col(body).cast("binary"), F.lit(b"")).alias("body"), F.monotonically_increasing_id().alias("row"),
    ).withColumns({"size": F.octet_length("body"), "digest": F.sha1("body"), "witness": F.sha2("body", 256)}))
    folder = _decided(staged, least_bytes)
    date, call = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), uuid.uuid4()
    index = _index(kind_of)

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        system, base = fs.FileSystem.from_uri(_uri(path))
        system.create_dir(base, recursive=True)
        name, n, out, at, file = None, 0, [], 0, None
        part, away = None, {}
        stem = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        named = lambda row: uuid.uuid5(call, str(row))
        for batch in batches:
            ids_of = batch.schema.field("id").type
            for start in range(0, batch.num_rows, 200):
                for r in batch.slice(start, 200).to_pylist():
                    row, payload = r["row"], r["body"]
                    if row >> 33 != part:
                        part = row >> 33
                        away = _revisits(folder, part)
                    to, original = away.get(row, (None, None))
                    kind = "revisit" if row in away else "response"
                    raw = _record(named(row), date, r["id"], r["location"], payload, r["digest"], kind, to, named(original))
                    if file is None:
                        name, n, at = f"{stem}-{n:04d}.warc.gz", n + 1, 0
                        file = system.open_output_stream(f"{base}/{name}", compression=None)
                    file.write(raw)
                    out.append((r["id"], name, at, len(raw), r["location"], r["digest"], len(payload), kind, to))
                    at += len(raw)
                    if at >= FILE_BYTES:
                        file.close()
                        file = None
                if file is None or len(out) >= 2000:
                    yield _table(pa, out, ids_of)
                    out = []
        if file is not None:
            file.close()
        if out:
            yield _table(pa, out, ids_of)

    return cut_lineage(staged.select("id", "location", "body", "row", "digest").mapInArrow(write, index))


def _table(pa, out, ids_of):
    kinds = (ids_of, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), ids_of)
    names = [c.split()[0] for c in _index("long").split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names)


def read_archives(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """The records that ``index`` selects, read from the archives below ``path``.

    Filter the index first: only selected byte ranges are read. Ranges of one archive are sorted,
    and neighbours closer than 64 KB are fetched in one read of at most 8 MB. Every payload is
    held against its digest and length. Tasks read about 8 MB each, also of one archive. Returns ``id, location, record_type, refers_to,
    payload_digest, payload_bytes, payload``; a revisit has no payload of its own.
    """
    kind_of = index.schema["id"].dataType.simpleString()
    columns = _recorded(kind_of)

    def fetch(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(_uri(path))
        ids_of = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind_of]
        kinds = (ids_of, pa.string(), pa.string(), ids_of, pa.string(), pa.int64(), pa.binary())
        names = [c.split()[0] for c in columns.split(", ")]
        name, file = None, None

        def read(span, parts):
            file.seek(span[0])
            raw = file.read(span[1] - span[0])
            out = [_parse(raw[a - span[0]:b - span[0]]) for a, b in parts]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names)

        for batch in batches:
            span, parts = None, []
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                end = offset + length
                if span and archive == name and offset - span[1] <= GAP_BYTES and end - span[0] <= READ_BYTES:
                    span = (span[0], max(span[1], end))
                    parts.append((offset, end))
                    continue
                if span:
                    yield read(span, parts)
                if archive != name:
                    if file:
                        file.close()
                    name, file = archive, system.open_input_file(f"{base}/{archive}")
                span, parts = (offset, end), [(offset, end)]
            if span:
                yield read(span, parts)
        if file:
            file.close()

    wanted = index.select("archive", "offset", "length")
    total = wanted.agg(F.sum("length")).first()[0] or 0
    # the index is small where the archives are large: a fixed number of tasks, by archive and range
    dealt = wanted.repartition(-(-total // READ_BYTES) or 1, "archive", F.floor(F.col("offset") / READ_BYTES))
    return dealt.sortWithinPartitions("archive", "offset").mapInArrow(fetch, columns)
