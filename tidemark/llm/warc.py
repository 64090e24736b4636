"""WARC archives: writing, and normalising archives that were compressed as one stream.

A whole-file gzip stream cannot be entered at a record. The normaliser inflates such a stream once, from front to back,
writes every record as a gzip member of its own, and keeps an index (file, offset, length and the main headers) beside
the archive. With the index any record is read by one seek.

Files are named anew by every attempt of a task, and only the names that a finished task returned are used, so an
attempt that is lost or runs twice leaves at most a file that nobody reads.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import freeze, frozen_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Payloads of fewer bytes are always stored.
LEAST_REVISIT = 100
#: Bytes of payload after which a new archive is begun.
ROLL_BYTES = 32 << 20
LEVEL = 4
CHUNK = 1 << 18
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "file string, offset long, length long, record_type string, uri string, page_id long, payload_digest string, refers_to long"
PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def open_folder(folder: str):
    """(file system, path) of a folder given as path or address."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return system, path


def record_id(page_id, digest: str) -> str:
    import uuid

    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def header_value(text: str | None) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in text or "")


def record(page_id, url, payload: bytes, digest: str, refers_to, is_revisit: bool) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {header_value(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if is_revisit:
        lines.append(f"WARC-Profile: {PROFILE}")
        if refers_to is not None:
            lines += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    else:
        block += payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    """Header fields by lower-case name, without the version line."""
    fields = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return fields


def inflated(stream):
    """Bytes of a gzip file in pieces, whether it has one member or many."""
    import zlib

    inflate, begun = zlib.decompressobj(31), False
    while chunk := stream.read(CHUNK):
        while chunk:
            begun = True
            yield inflate.decompress(chunk)
            chunk = inflate.unused_data
            if inflate.eof:
                inflate, begun = zlib.decompressobj(31), False
    if begun:
        raise ValueError("the gzip stream ends early")


def records(pieces):
    """(header, block) of every record of an inflated stream."""
    held = bytearray()
    pieces = iter(pieces)

    def fill(enough) -> bool:
        while not enough():
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        if not fill(lambda: b"\r\n\r\n" in held):
            if held.strip():
                raise ValueError("the archive ends inside a record header")
            return
        end = held.index(b"\r\n\r\n")
        head = bytes(held[:end])
        if not head.lstrip(b"\r\n").startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        size = int(headers(head)["content-length"])
        last = end + 4 + size + 4
        if not fill(lambda last=last: len(held) >= last):
            raise ValueError("the archive ends inside a record")
        yield head, bytes(held[end + 4 : end + 4 + size])
        del held[:last]


def _writer(folder: str):
    import pyarrow as pa

    def run(batches):
        import uuid
        import zlib

        stream, deflate, name, size, done = None, None, None, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if stream is None:
                    system, path = open_folder(folder)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    stream, deflate, size = system.open_output_stream(f"{path}/{name}", compression=None), zlib.compressobj(LEVEL, wbits=31), 0
                payload = row["payload"]
                stream.write(deflate.compress(record(row["page_id"], row["url"], payload, row["digest"], row["refers_to"], row["is_revisit"])))
                size += len(payload)
                if size >= ROLL_BYTES:
                    stream.write(deflate.flush())
                    stream.close()
                    stream, done = None, [*done, name]
        if stream is not None:
            stream.write(deflate.flush())
            stream.close()
            done.append(name)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["file"])

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes every page as a record of whole-stream gzip archives below `folder`; returns their names (file).

    Of equal payloads of at least LEAST_REVISIT bytes the page with the smallest page_id is stored, the others refer to
    it; of rows that also share that id, one is stored. A row without page_id refers to a page that has one, and is
    stored if none has. A NULL html is an empty payload.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.where(F.octet_length("payload") >= LEAST_REVISIT)
    same = large.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(
        F.min("page_id").alias("least"), F.sum("n").alias("rows"),
        F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "n"))).alias("first"),
    )
    same = freeze(same.where((F.col("rows") > 1) & F.col("least").isNotNull()).select("digest", "least", F.col("first.n").alias("n")))
    same = same.withColumnRenamed("digest", "same_digest")
    joined = rows.join(same, (F.col("digest") == F.col("same_digest")) & (F.octet_length("payload") >= LEAST_REVISIT), "left")
    known = F.col("least").isNotNull()
    is_first = F.col("page_id").eqNullSafe(F.col("least"))
    repeated = known & is_first & (F.col("n") > 1)
    columns = ["page_id", "url", "payload", "digest", F.when(F.col("is_revisit"), F.col("least")).alias("refers_to"), "is_revisit"]
    out = joined.where(~repeated).withColumn("is_revisit", known & ~is_first).select(*columns)
    if not same.where("n > 1").isEmpty():
        turn = F.row_number().over(Window.partitionBy("digest", "page_id").orderBy("url"))
        out = out.union(joined.where(repeated).withColumn("is_revisit", turn > 1).select(*columns))
    return freeze(out.mapInArrow(_writer(folder), "file string"))


def _normaliser(source: str, target: str):
    import pyarrow as pa

    def run(batches):
        import json
        import uuid
        import zlib

        names = [n.split()[0] for n in INDEX.split(", ")]
        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, path = open_folder(source)
                out_system, out_path = open_folder(target)
                name = f"{uuid.uuid4().hex}.warc.gz"
                rows, offset = [], 0
                with (
                    system.open_input_stream(f"{path}/{file}", compression=None) as stream,
                    out_system.open_output_stream(f"{out_path}/{name}", compression=None) as out,
                    out_system.open_output_stream(f"{out_path}/{name}.index") as index,
                ):
                    for head, block in records(inflated(stream)):
                        deflate = zlib.compressobj(LEVEL, wbits=31)
                        member = deflate.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()
                        out.write(member)
                        own = headers(head)
                        page, refers = own.get("x-page-id"), own.get("x-refers-to-page")
                        row = (
                            name, offset, len(member), own.get("warc-type"), own.get("warc-target-uri"), page and int(page),
                            own.get("warc-payload-digest", "").removeprefix("sha256:"), refers and int(refers),
                        )
                        index.write(json.dumps(dict(zip(names[1:], row[1:], strict=True))).encode() + b"\n")
                        rows.append(row)
                        offset += len(member)
                        if len(rows) == 4096:
                            yield _index_rows(rows, names)
                            rows = []
                if rows:
                    yield _index_rows(rows, names)

    def _index_rows(rows, names):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def normalise(files: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrites archives below `source` as one gzip member per record below `target`; returns the index rows.

    Every archive is read once, front to back, by one task that holds one record at a time. Archives that already have
    members are accepted. A stream or record that ends early raises an error.
    """
    n = max(1, files.count())
    return freeze(files.repartition(n).mapInArrow(_normaliser(source, target), INDEX))


def _reader(folder: str):
    import pyarrow as pa

    def run(batches):
        import hashlib
        import zlib

        system = path = name = stream = None
        for batch in batches:
            rows = []
            for at in batch.to_pylist():
                if at["file"] != name:
                    if stream is not None:
                        stream.close()
                    system, path = open_folder(folder) if system is None else (system, path)
                    name, stream = at["file"], system.open_input_file(f"{path}/{at['file']}")
                stream.seek(at["offset"])
                head, block = next(records([zlib.decompress(stream.read(at["length"]), wbits=31)]))
                own = headers(head)
                http, _, payload = block.partition(b"\r\n\r\n")
                page, refers = own.get("x-page-id"), own.get("x-refers-to-page")
                if own["warc-type"] == "response":
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    if own["warc-payload-digest"] != f"sha256:{digest}":
                        raise ValueError(f"{name} at {at['offset']}: the payload does not have its digest")
                else:
                    size, digest = int(headers(http)["content-length"]), own["warc-payload-digest"].removeprefix("sha256:")
                rows.append((page and int(page), size, digest, own["warc-type"], refers and int(refers)))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                names = [n.split()[0] for n in PAGES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every indexed record, from the archives.

    Each record is fetched by its offset; the digest of a stored payload is computed anew and must be the header's.
    """
    # A stated number of partitions is kept; without it the few bytes of the index end up in one task.
    n = max(1, index.select("file").distinct().count())
    ranges = index.select("file", "offset", "length").repartition(n, "file").sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(_reader(folder), PAGES)


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Pages written as whole-stream archives, normalised, and read back by the index."""
    folder = folder or frozen_path(pages.sparkSession)
    files = write_archives(pages, f"{folder}/streams")
    return read_records(normalise(files, f"{folder}/streams", f"{folder}/members"), f"{folder}/members")


SQL = """WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT payload_digest, min(page_id) AS least FROM p WHERE n >= 100 GROUP BY payload_digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN n >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> least THEN least END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""
