"""WARC archives: write, normalise monolithic gzip streams to one member a record, read back by offset."""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, quoted, written
from .files import NamedFile, store_of

#: Bytes read, inflated or written at once.
CHUNK = 1 << 20
#: A writer starts a new archive when one has so many bytes of records.
ARCHIVE_BYTES = 64 << 20
INDEX = "archive string, offset long, length long, record_id string, record_type string, uri string, refers_to string, payload_digest string, payload_bytes long"


def record_head(kind: str, page_id: int | None, url: str | None, digest: str, refers_to: int | None, length: int) -> bytes:
    """Headers of a record, up to and with the blank line."""
    target = "".join(c for c in url or "" if c not in "\r\n")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write_archives(pages: DataFrame, folder: str, smallest: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each page into gzip archives, each one whole-file stream; returns archive, records, bytes.

    Of pages with equal payloads of at least `smallest` bytes, that with the
    largest id is the response and the others revisit it, without payload. The
    digests meet by a join that Spark can split where one payload has many
    pages; only digests and ids are grouped.
    """
    payload = F.encode(F.coalesce(F.col(quoted(html_col)).cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col(quoted(id_col)).cast("long").alias("page_id"), F.col(quoted(url_col)).cast("string").alias("url"), payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    first = rows.filter(F.octet_length("payload") >= smallest).groupBy("sha1").agg(F.max("page_id").alias("largest"))
    dealt = rows.join(first, "sha1", "left").withColumn("refers_to", F.when((F.octet_length("payload") >= smallest) & (F.coalesce("page_id", F.lit(-1)) != F.coalesce("largest", F.lit(-1))), F.col("largest")))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context, made, file = TaskContext.get(), 0, None
        name, press, records, size = "", None, 0, 0

        def end() -> pd.DataFrame:
            file.out.write(press.flush())
            file.close()
            return pd.DataFrame({"archive": [name], "records": [records], "bytes": [size]})

        for frame in frames:
            for page_id, url, body, sha1, refers_to in zip(frame["page_id"].astype("Int64"), frame["url"], frame["payload"], frame["sha1"], frame["refers_to"].astype("Int64"), strict=True):
                page, to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                revisit = to is not None
                if file is None:
                    name = f"{folder}/whole/part-{context.partitionId():05d}-{made:04d}.warc.gz"
                    file, press, records, size, made = NamedFile(name), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0, made + 1
                body = b"" if revisit else bytes(body)
                head = record_head("revisit" if revisit else "response", page, None if pd.isna(url) else url, base64.b32encode(bytes.fromhex(sha1)).decode(), to, len(body))
                for piece in (head, body, b"\r\n\r\n"):
                    file.out.write(press.compress(piece))
                records, size = records + 1, size + len(head) + len(body) + 4
                if size >= ARCHIVE_BYTES:
                    yield end()
                    file = None
        if file is not None:
            yield end()

    return written(dealt.select("page_id", "url", "payload", "sha1", "refers_to").mapInPandas(write, "archive string, records long, bytes long"), "warc-archives")


def _inflated(uri: str) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, a chunk at a time."""
    store, path = store_of(uri)
    with store.open_input_stream(path, compression=None) as raw:
        inflate = zlib.decompressobj(31)
        while data := raw.read(CHUNK):
            while data:
                out = inflate.decompress(data, CHUNK)
                if out:
                    yield out
                if inflate.eof:
                    data, inflate = inflate.unused_data, zlib.decompressobj(31)
                else:
                    data = inflate.unconsumed_tail


def _records(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, dict[str, str], Iterator[bytes]]]:
    """Head, fields and content (to be read before the next record) of every record of an inflated archive."""
    buffer = bytearray()

    def more() -> bool:
        data = next(chunks, None)
        if data is not None:
            buffer.extend(data)
        return data is not None

    def content(left: int) -> Iterator[bytes]:
        while left:
            if not buffer and not more():
                raise ValueError("the archive ends within a record")
            piece = bytes(buffer[:left])
            del buffer[: len(piece)]
            left -= len(piece)
            yield piece

    while True:
        while (cut := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer.strip():
                    raise ValueError("the archive ends within a record's head")
                return
        head = bytes(buffer[: cut + 4])
        del buffer[: cut + 4]
        lines = head.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}
        body = content(int(fields["content-length"]))
        yield head, fields, body
        for _ in body:
            pass
        while len(buffer) < 4 and more():
            pass
        if bytes(buffer[:4]) != b"\r\n\r\n":
            raise ValueError("a record does not end with two line breaks")
        del buffer[:4]


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites archives so that every record is a gzip member of its own; returns the index, a row for each record.

    Each archive is inflated once, as a stream, and its records go out as they
    come in, a chunk at a time. Beside each new archive lies its index in lines
    of JSON (offset, length, record id, type, URI, reference, digest).
    """

    def rewrite(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for old in frame["archive"]:
                name = f"{folder}/members/{old.rpartition('/')[2]}"
                file, side, at, rows = NamedFile(name), NamedFile(f"{name}.index"), 0, []
                for head, fields, body in _records(_inflated(old)):
                    press, start, size = zlib.compressobj(6, zlib.DEFLATED, 31), at, 0

                    def put(data: bytes, file=file) -> int:
                        file.out.write(data)
                        return len(data)

                    at += put(press.compress(head))
                    for piece in body:
                        size += len(piece)
                        at += put(press.compress(piece))
                    at += put(press.compress(b"\r\n\r\n")) + put(press.flush())
                    row = {"archive": name, "offset": start, "length": at - start, "record_id": fields["warc-record-id"], "record_type": fields["warc-type"], "uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"), "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"), "payload_bytes": size}
                    side.out.write((json.dumps(row) + "\n").encode())
                    rows.append(row)
                    if len(rows) >= 5000:
                        yield pd.DataFrame(rows)
                        rows = []
                file.close()
                side.close()
                if rows:
                    yield pd.DataFrame(rows)

    spread = archives.select("archive").repartition(max(1, archives.count()))
    return written(spread.mapInPandas(rewrite, INDEX), "warc-index")


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Reads the records that the index lists, each from its own member; checks every response against its digest.

    Adds digest_found (null for a revisit) and, if wanted, payload.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, raw = None, None
        for frame in frames:
            found, bodies = [], []
            for name, offset, length in zip(frame["archive"], frame["offset"], frame["length"], strict=True):
                if name != held:
                    if raw is not None:
                        raw.close()
                    store, path = store_of(name)
                    held, raw = name, store.open_input_file(path)
                member = zlib.decompress(raw.read_at(int(length), int(offset)), 31)
                _, fields, body = next(_records(iter([member])))
                payload = b"".join(body)
                revisit = fields["warc-type"] == "revisit"
                digest = None if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if not revisit and f"sha1:{digest}" != fields["warc-payload-digest"]:
                    raise ValueError(f"{name} at {offset}: the payload does not have the digest that its head states")
                found.append(digest)
                if with_payload:
                    bodies.append(None if revisit else payload)
            out = frame.assign(digest_found=found)
            yield out.assign(payload=bodies) if with_payload else out
        if raw is not None:
            raw.close()

    schema = f"{INDEX}, digest_found string" + ", payload binary" * with_payload
    return index.sortWithinPartitions("archive", "offset").mapInPandas(read, schema)


def archived_pages(pages: DataFrame, folder: str | None = None, smallest: int = 0, **columns) -> DataFrame:
    """Writes pages to archives, normalises these, and reads every record back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to for
    every row of pages; a revisit has the size of the record it refers to. Null
    html is an empty payload; a null id sorts before all others; rows that
    repeat an id each have a record, all with the largest id being responses;
    an empty table gives no rows. Line breaks in URLs are dropped from heads.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    index = normalise_archives(write_archives(pages, folder, smallest, **columns), folder)
    page = r"<urn:page:(-?\d+)>"
    rows = written(read_records(index, with_payload=False), "warc-records").select(
        F.expr(f"try_cast(regexp_extract(record_id, r'{page}', 1) as bigint)").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.expr(f"try_cast(regexp_extract(refers_to, r'{page}', 1) as bigint)").alias("refers_to"),
    )
    sizes = rows.filter("record_type = 'response'").groupBy(F.col("payload_digest").alias("d")).agg(F.max("payload_bytes").alias("size"))
    return rows.join(sizes, (F.col("payload_digest") == F.col("d")) & (F.col("record_type") == "revisit"), "left").select(
        "page_id", F.coalesce("size", "payload_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )
