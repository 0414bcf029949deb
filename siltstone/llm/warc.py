"""WARC archives: monolithic gzip streams, their normaliser (one member per record), and an offset index."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, text_blocks

#: Payloads of fewer bytes are never revisits.
MIN_BYTES = 100
DATE = "1970-01-01T00:00:00Z"
BLOCK = 1 << 20

PAGE_FIELDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that all machines share, and the path in it."""
    return fs.FileSystem.from_uri(uri.replace("file:", "file://", 1) if re.match(r"file:/(?!/)", uri) else uri)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def headers(first: str, fields: list[tuple[str, object]]) -> bytes:
    return (first + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    return headers("WARC/1.1", [*fields, ("Content-Length", len(block))]) + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """A response record, or a revisit without the payload: its HTTP header still tells the payload's length."""
    http = headers("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))])
    fields = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else f"urn:page:{page_id}"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Page-Id", page_id),
    ]
    if is_revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", refers_to)]
    return record([*fields, ("Content-Type", "application/http; msgtype=response")], http if is_revisit else http + payload)


def file_info(name: str) -> bytes:
    return record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, name)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def parse_headers(raw: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in raw.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of a gzip file of one or many members, in blocks of bounded size.

    Raises ValueError where the file ends inside a member, its trailer included.
    """
    stream, begun = zlib.decompressobj(31), False
    for chunk in chunks:
        while chunk:
            begun = True
            if out := stream.decompress(chunk, BLOCK):
                yield out
            if stream.eof:
                chunk, stream, begun = stream.unused_data, zlib.decompressobj(31), False
            else:
                chunk = stream.unconsumed_tail
    while begun and (out := stream.decompress(b"", BLOCK)):
        yield out
    if begun and not stream.eof:
        raise ValueError("the archive breaks off inside a gzip member")


def records(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole WARC records of an inflated stream, one at a time."""
    held = bytearray()
    need = None
    for block in blocks:
        held += block
        while True:
            if need is None:
                if (end := held.find(b"\r\n\r\n")) < 0:
                    break
                need = end + 4 + int(parse_headers(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the archive breaks off inside a record")


def chunks(file: pa.NativeFile) -> Iterator[bytes]:
    while chunk := file.read(BLOCK):
        yield chunk


def _own_name(folder: str, ending: str) -> str:
    """A file name that no other attempt at the same task uses; only names that a task returns are read."""
    task = TaskContext.get()
    return f"{folder}/part-{task.partitionId() if task else 0:05d}-{uuid.uuid4().hex}{ending}"


def write_monolithic(pages: DataFrame, root: str) -> DataFrame:
    """(path): an archive per task, compressed as one gzip stream over the whole file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = filesystem(root)
        path = out = None
        for part, texts in text_blocks(batches, "html"):
            if not part.num_rows:
                continue
            if out is None:
                system.create_dir(f"{folder}/monolithic", recursive=True)
                path = _own_name(f"{folder}/monolithic", ".warc.gz")
                out, stream = system.open_output_stream(path, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(stream.compress(file_info(path.rpartition("/")[2])))
            rows = zip(texts, *(part.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to", "is_revisit")), strict=True)
            for text, page_id, url, digest, refers_to, is_revisit in rows:
                out.write(stream.compress(page_record(page_id, url, (text or "").encode(), digest, refers_to, is_revisit)))
        if out is not None:
            out.write(stream.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path]})

    return pages.select("page_id", "url", "html", "digest", "refers_to", "is_revisit").mapInArrow(run, "path string")


def normalise(files: DataFrame, root: str) -> DataFrame:
    """(path, index): each archive inflated once and rewritten with a gzip member per record.

    Beside each archive stands a sidecar index, a line per record: offset, length, type, record id.
    One block of input and one record are in memory at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = filesystem(root)
        system.create_dir(f"{folder}/archives", recursive=True)
        for batch in batches:
            for source in batch.column("path").to_pylist():
                path, offset = _own_name(f"{folder}/archives", ".warc.gz"), 0
                with system.open_input_stream(source, compression=None) as into, system.open_output_stream(path, compression=None) as out, system.open_output_stream(f"{path}.idx", compression=None) as index:
                    for one in records(inflate(chunks(into))):
                        stream = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = stream.compress(one) + stream.flush()
                        head = parse_headers(one[: one.find(b"\r\n\r\n")])
                        out.write(member)
                        index.write(f"{offset} {len(member)} {head['warc-type']} {head['warc-record-id']}\n".encode())
                        offset += len(member)
                yield pa.RecordBatch.from_pydict({"path": [path], "index": [f"{path}.idx"]})

    return files.mapInArrow(run, "path string, index string")


def read_archives(files: DataFrame, root: str) -> DataFrame:
    """PAGE_FIELDS of each page record, found by the index and read from its own member.

    A response's length and digest come from its payload, which must match the recorded digest; a
    revisit's come from its headers.
    """

    def row(one: bytes) -> tuple | None:
        cut = one.find(b"\r\n\r\n")
        head, block = parse_headers(one[:cut]), one[cut + 4 : -4]
        if head["warc-type"] not in ("response", "revisit"):
            return None
        digest = head["warc-payload-digest"].removeprefix("sha256:")
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(parse_headers(http)["content-length"])
        if head["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"the payload of {head['warc-record-id']} does not match its digest")
        number = lambda name: int(head[name]) if name in head else None
        return number("x-page-id"), size, digest, head["warc-type"], number("x-refers-to-page")

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(root)
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist(), strict=True):
                with system.open_input_stream(index, compression=None) as lines:
                    entries = [line.split() for line in lines.read().splitlines()]
                rows: list[tuple] = []
                with system.open_input_file(path) as archive:
                    for offset, length, *_ in entries:
                        found = row(zlib.decompress(archive.read_at(int(length), int(offset)), 31))
                        rows += [found] if found else []
                        if len(rows) == 4096:
                            yield pa.record_batch([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.record_batch([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.mapInArrow(run, PAGE_FIELDS)


def plan_records(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int, scratch: Scratch) -> DataFrame:
    """(page_id, url, html, digest, refers_to, is_revisit): of equal payloads the smallest page_id answers for the others.

    Which page that is comes from small rows with partial sums; the payloads are dealt by page,
    so pages with one common payload spread over all tasks.
    """
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").alias("url"), html.alias("html"))
    small = rows.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("bytes")).filter(F.col("bytes") >= min_bytes)
    first = small.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    # as a written table both sides of the next join are shuffled for it, and a payload with very many pages is split
    first = scratch.save(first.drop("n"), "first")
    revisits = small.join(first, "digest").filter("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()
    return rows.withColumn("digest", F.sha2("html", 256)).join(revisits, ["page_id", "digest"], "left").withColumn("is_revisit", F.col("refers_to").isNotNull())


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Write pages as WARC archives and read them back.

    Returns (files, pages): the archives' paths with their sidecar indexes, and PAGE_FIELDS of
    each page from what stands in the archives. Archives go to ``root``, a folder that all
    machines share (by default in spark.checkpoint.dir). The monolithic streams are removed once
    they are normalised. A task that is repeated writes files of its own; only those of the
    attempt that counted are read.

    A null html is an empty payload, a null url becomes urn:page:<id>. Of equal payloads of
    ``min_bytes`` or more that with the smallest page_id is the response and the others revisit it;
    rows without an id and repeated rows of the smallest id are responses. An empty table writes
    no archive; other columns are ignored, whatever their names.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    root = root or scratch.root
    written = scratch.save(write_monolithic(plan_records(pages, id_col, url_col, html_col, min_bytes, scratch), root), "written")
    spread = lambda df: df.repartition(max(1, df.count()))
    files = scratch.save(normalise(spread(written), root), "files")
    scratch.drop(written, f"{root}/monolithic")
    return files, read_archives(spread(files), root)
