"""WARC archives through a chunked record table.

A payload never travels as one value: ``chunk_table`` has one row per record
and chunk number, and each carries the SHA-1 of the payload up to and
including its chunk, so the last one carries the payload's digest. Writers and
readers stream chunks: a task holds one chunk and a digest state, whatever the
size of a record.

``write_archives`` makes one response or revisit record per row. Of records
with equal payloads of at least ``least`` bytes, that of the largest id is the
response and the others revisit it; smaller ones are all responses. Records are
dealt to archives by a hash, in bounded files (``*.warc.gz``, one gzip member
per record) written under the shared folder: first under a name of the task's
attempt, then renamed, so a task that is run again leaves one archive.
``read_archives`` streams the files back into a chunked record table and checks
every digest.

Defined results: a null payload counts as empty; an empty payload is one chunk
of no bytes; repeated rows (same id, URL and payload) are records of their own,
of which, from ``least`` bytes on, one is the response and the others revisit
it; null ids and URLs are kept as null; an empty table gives no archive and an
empty result; columns other than the three named ones aren't archived.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from urllib.parse import quote, unquote
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkcast.session import scratch_path

from .util import save

CHUNK = 256 << 10
LEAST = 1000
ROLL = 256 << 20        # compressed bytes after which an archive is closed
DATE = "1970-01-01T00:00:00Z"           # archives of the same rows are the same bytes
_NO_ID = -(1 << 63)


# --- chunked record table --------------------------------------------------

def _running_digests(batches):
    """Add to each chunk the digest of its record so far; chunks come in order."""
    state, at = None, 0
    for b in batches:
        digests = []
        for no, chunk in zip(b.column("no").to_pylist(), b.column("chunk")):
            if no == 0:
                state = hashlib.sha1()
            state.update(chunk.as_buffer())
            digests.append(state.copy().hexdigest())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digests, pa.string())], [*b.schema.names, "digest"])


def chunk_table(df: DataFrame, id_col: str, url: str, payload: str, chunk: int = CHUNK) -> DataFrame:
    """(id, url, th, size, no, chunk, digest): rows of a record in order, ``digest``
    of the payload up to this chunk. th: hash that tells rows of one id apart."""
    raw = F.coalesce(F.col(f"`{payload}`"), F.lit("")).cast("binary")
    rows = df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID)).alias("id"), F.col(f"`{url}`").cast("string").alias("url"), raw.alias("_p"))
    rows = rows.withColumn("th", F.xxhash64("_p", "url")).withColumn("size", F.octet_length("_p").cast("long"))
    parts = (rows.select("id", "url", "th", "size", "_p", F.explode(F.expr(f"sequence(0, cast(greatest(size - 1, 0) div {chunk} as int))")).alias("no"))
             .select("id", "url", "th", "size", "no", F.expr(f"substring(_p, no * {chunk} + 1, {chunk})").alias("chunk")))
    return parts.mapInArrow(_running_digests, "id long, url string, th long, size long, no int, chunk binary, digest string")


def decisions(chunks: DataFrame, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """(id, url, th, size, digest, copies, response, refers_to) of every distinct
    row, from the last chunk of each: how often it occurs, whether its first
    copy is the response, and what its revisits refer to."""
    last = chunks.filter(F.col("no") == F.floor(F.greatest(F.col("size") - 1, F.lit(0)) / chunk)).drop("chunk", "no")
    ends = save(last.groupBy("id", "url", "th", "size", "digest").agg(F.count("*").cast("int").alias("copies")))
    # equal payloads: only groups of several records are looked up again
    groups = save(ends.filter(F.col("size") >= least).groupBy("digest", "size")
                  .agg(F.count("*").alias("c"), F.max(F.struct("id", "th")).alias("top")).filter("c > 1")
                  .select("digest", "size", F.col("top.id").alias("of"), F.col("top.th").alias("of_th")))
    first = (F.col("size") < least) | F.col("of").isNull() | ((F.col("id") == F.col("of")) & (F.col("th") == F.col("of_th")))
    return (ends.join(groups, ["digest", "size"], "left")
            .select("id", "url", "th", "size", "digest", "copies", first.alias("response"), F.coalesce("of", "id").alias("refers_to")))


# --- archives --------------------------------------------------------------

def record_uri(i: int, copy: int) -> str:
    """Record id that carries a row's id and copy number."""
    return f"urn:uuid:{uuid.UUID(bytes=(i & (1 << 64) - 1).to_bytes(8, 'big') + copy.to_bytes(8, 'big'))}"


def row_id(uri: str) -> int:
    return int.from_bytes(uuid.UUID(uri).bytes[:8], "big", signed=True)


def _header(r: dict) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {r['record_type']}", f"WARC-Record-ID: <{record_uri(r['id'], r['copy'])}>", f"WARC-Date: {DATE}"]
    if r["url"] is not None:
        line = r["url"].replace("\r", "%0D").replace("\n", "%0A").strip()
        lines.append("WARC-Target-URI: " + line)
        if line != r["url"]:                # a header line can't hold it as it is
            lines.append("X-URL: " + quote(r["url"], safe=""))
    lines.append(f"WARC-Payload-Digest: sha1:{r['digest']}")
    if r["record_type"] == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_uri(r['refers_to'], 0)}>",
                  f"X-Payload-Length: {r['size']}", "Content-Length: 0"]
    else:
        lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {r['size']}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


class Archive:
    """An archive being written; it appears under its name when it is closed."""

    def __init__(self, folder: str, name: str):
        self.fs, root = fs.FileSystem.from_uri(folder)
        self.name, self.path, self.temporary = name, posixpath.join(root, name), posixpath.join(root, f".{uuid.uuid4().hex}")
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.size = 0
        self.member = None

    def _put(self, b: bytes):
        if b:
            self.out.write(b)
            self.size += len(b)

    def begin(self, header: bytes):
        self.member = zlib.compressobj(6, zlib.DEFLATED, 31)
        self._put(self.member.compress(header))

    def add(self, chunk):
        self._put(self.member.compress(chunk))

    def end(self):
        self._put(self.member.compress(b"\r\n\r\n") + self.member.flush())

    def close(self) -> tuple[str, int]:
        self.out.close()
        self.fs.move(self.temporary, self.path)
        return self.name, self.size


def _write(folder: str, roll: int, least: int):
    """Decision rows (no -1), each before its record's chunks, to archives; yields (name, bytes)."""
    def run(batches):
        from pyspark import TaskContext
        part, made = TaskContext.get().partitionId(), []
        archive, record, begun, held, seen = None, None, False, [], None

        def out() -> Archive:
            nonlocal archive
            if archive is not None and archive.size >= roll:
                made.append(archive.close())
                archive = None
            if archive is None:
                archive = Archive(folder, f"part-{part:06d}-{len(made):05d}.warc.gz")
            return archive

        def finish():
            """End the open response; the other copies of the row follow."""
            if begun:
                archive.end()
            for copy in range(1 if record["response"] else 0, record["copies"]):
                again = dict(record, copy=copy, record_type="response" if record["size"] < least else "revisit")
                out().begin(_header(again))
                for piece in held if again["record_type"] == "response" else ():
                    archive.add(piece)
                archive.end()

        for b in batches:
            chunks = b.column("chunk")
            for k, r in enumerate(b.drop_columns(["chunk"]).to_pylist()):
                if r["no"] < 0:
                    if record is not None:
                        finish()
                    record, begun, held, seen = r, False, [], -1
                elif r["no"] != seen and record["response"]:        # the same chunk of a repeated row is skipped
                    seen = r["no"]
                    if not begun:
                        out().begin(_header(dict(record, copy=0, record_type="response")))
                        begun = True
                    piece = chunks[k].as_py()
                    archive.add(piece)
                    if record["copies"] > 1 and record["size"] < least:
                        held.append(piece)
        if record is not None:
            finish()
            made.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in made], pa.string()), pa.array([x for _, x in made], pa.int64())], ["archive", "bytes"])
    return run


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST,
                   chunk: int = CHUNK, roll: int = ROLL) -> DataFrame:
    """Write a record per row under ``folder`` (shared, made if absent); (archive, bytes) of what was written."""
    filesystem, root = fs.FileSystem.from_uri(folder)
    filesystem.create_dir(root, recursive=True)
    known = save(decisions(chunk_table(df, id_col, url, payload, chunk), least, chunk))
    chunks = chunk_table(df, id_col, url, payload, chunk)
    # decisions and chunks meet in one shuffle, in the order of the archive
    rows = known.withColumns({"no": F.lit(-1), "chunk": F.lit(None).cast("binary")}).unionByName(chunks.drop("digest", "size"), allowMissingColumns=True)
    return save(rows.repartition("id", "th").sortWithinPartitions("id", "th", "url", "no").mapInArrow(_write(folder, roll, least), "archive string, bytes long"))


# --- reading ---------------------------------------------------------------

def _members(stream, size: int = 1 << 20):
    """Decompressed pieces of a stream of gzip members, None after each member."""
    d, rest = zlib.decompressobj(31), b""
    while True:
        data = rest or stream.read(size)
        rest = b""
        if not data:
            return
        piece = d.decompress(data, size)
        rest = d.unconsumed_tail
        if piece:
            yield piece
        if d.eof:
            yield None
            rest, d = d.unused_data, zlib.decompressobj(31)


def read_records(stream, chunk: int = CHUNK):
    """(headers, chunk number, chunk, is last) of the records of an archive."""
    head, body, no, left = None, bytearray(), 0, 0
    for piece in _members(stream):
        if piece is None:
            if head is None or left or bytes(body[-4:]) != b"\r\n\r\n":
                raise ValueError("a record ends too early")
            head, body, no = None, bytearray(), 0
            continue
        body += piece
        if head is None:
            end = body.find(b"\r\n\r\n")
            if end < 0:
                continue
            first, *lines = body[:end].decode().split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError("not a WARC record")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            del body[:end + 4]
            left = int(head["content-length"])
            if not left:
                yield head, 0, b"", True
        while left and len(body) >= min(chunk, left):
            n = min(chunk, left)
            left -= n
            yield head, no, bytes(body[:n]), not left
            del body[:n]
            no += 1


def _read(folder: str, chunk: int, keep_chunks: bool):
    def run(batches):
        filesystem, root = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("no", pa.int32()), ("chunk", pa.binary()), ("last", pa.bool_()), ("size", pa.int64()),
                            ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            for name in b.column("archive").to_pylist():
                rows, held = [], 0
                with filesystem.open_input_stream(posixpath.join(root, name), compression=None) as stream:
                    state, size = hashlib.sha1(), 0
                    for h, no, data, last in read_records(stream, chunk):
                        if no == 0:
                            state, size = hashlib.sha1(), 0
                        state.update(data)
                        size += len(data)
                        stated = h["warc-payload-digest"].partition(":")[2]
                        revisit = h["warc-type"] == "revisit"
                        if last and not revisit and state.hexdigest() != stated:
                            raise ValueError(f"{name}: payload of {h['warc-record-id']} does not have its digest")
                        i = row_id(h["warc-record-id"].strip("<>"))
                        rows.append({"id": None if i == _NO_ID else i, "url": unquote(h["x-url"]) if "x-url" in h else h.get("warc-target-uri"), "no": no, "chunk": data if keep_chunks else None, "last": last,
                                     "size": int(h["x-payload-length"]) if revisit else size, "digest": stated if revisit else state.hexdigest(),
                                     "record_type": h["warc-type"], "refers_to": to if revisit and (to := row_id(h["warc-refers-to"].strip("<>"))) != _NO_ID else None})
                        held += len(data) if keep_chunks else 0
                        if not keep_chunks and not last:
                            rows.pop()
                        if len(rows) >= 10_000 or held >= 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)
    return run


def read_archives(archives: DataFrame, folder: str, chunk: int = CHUNK, keep_chunks: bool = True) -> DataFrame:
    """Chunked record table of archives (column ``archive``: names in ``folder``):
    id, url, no, chunk, last, size and digest so far (of the whole payload for
    revisits), record_type, refers_to. Without ``keep_chunks`` only the last
    row of each record, without its bytes."""
    # bounded archives: one task each, however many there are
    spread = archives.select("archive").repartition("archive")
    return spread.mapInArrow(_read(folder, chunk, keep_chunks), "id long, url string, no int, chunk binary, last boolean, size long, digest string, record_type string, refers_to long")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own for archives, in the shared checkpoint folder."""
    path = scratch_path(spark, f"archives/{uuid.uuid4().hex}")
    if path.startswith("file:/") and not path.startswith("file://"):
        return "file://" + path[5:]
    return path if "://" in path else f"file://{path}"
