"""WARC archives: crawl files as one gzip stream each, normalised to one member per record with an offset index."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, shared_dir

#: Bytes of records, before compression, after which a writer begins another file.
ROTATE = 16_000_000
#: Date of records, fixed so that a rerun writes the same bytes.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open_store(uri: str):
    """(file system, path) of a folder's address; local paths, file:, hdfs: and object stores alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in str(value))


def _header(pairs: list[tuple[str, object]], first: str = "WARC/1.1") -> bytes:
    return "".join([first, "\r\n", *(f"{k}: {_clean(v)}\r\n" for k, v in pairs if v is not None), "\r\n"]).encode("utf-8")


def record_id(page_id, url, sha1: str) -> str:
    """The same for the page wherever it is written: header values as they are read back."""
    name = " ".join("None" if v is None else _clean(v).strip() for v in (page_id, url, sha1))
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def info(name: str) -> bytes:
    """The record that begins an archive and says what it is."""
    block = _header([("format", "WARC File Format 1.1"), ("conformsTo", "http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/")], "software: tallyforge")
    pairs = [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"),
        ("WARC-Date", DATE),
        ("WARC-Filename", name),
        ("Content-Type", "application/warc-fields"),
        ("Content-Length", len(block)),
    ]
    return _header(pairs) + block + b"\r\n\r\n"


def record(page_id, url, payload: bytes, sha1: str, refers_to=None, refers_url=None, revisit: bool = False, size: int | None = None) -> bytes:
    """A response with its HTTP head and payload, or a revisit with the head alone, which names the record that it repeats."""
    size = len(payload) if size is None else size
    block = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", size)], "HTTP/1.1 200 OK") + (b"" if revisit else payload)
    pairs = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, url, sha1)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{sha1}"),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", record_id(refers_to, refers_url, sha1) if revisit else None),
        ("WARC-Refers-To-Target-URI", refers_url if revisit else None),
        ("WARC-Refers-To-Date", DATE if revisit else None),
        ("X-Page-Id", page_id),
        ("X-Refers-To-Page-Id", refers_to),
        ("X-Payload-Length", size),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    return _header(pairs) + block + b"\r\n\r\n"


def _fields(stream) -> dict[str, str]:
    """The header lines at the stream's place; empty at its end."""
    found = {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        key, colon, value = line.decode("utf-8").partition(":")
        if colon:
            found[key.strip()] = value.strip()
    return found


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, payload) of each record of an inflated stream."""
    while head := _fields(stream):
        block = stream.read(int(head["Content-Length"]))
        stream.read(4)
        yield head, block[block.index(b"\r\n\r\n") + 4 :]


def write_crawl(pages: DataFrame, folder: str) -> DataFrame:
    """Write every page as a response into files that are one gzip stream each; a row for each record written.

    Each attempt of a task names its files anew, so those of lost attempts stay unread.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _open_store(folder)
        store.create_dir(root, recursive=True)
        out = None
        for batch in batches:
            rows = []
            for page_id, url, html in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                if out is None:
                    name, done, ordinal = f"crawl-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, deflate = store.open_output_stream(posixpath.join(root, name), compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                payload = b"" if html is None else html.encode("utf-8")
                data = record(page_id, url, payload, sha1 := digest(payload))
                out.write(deflate.compress(data))
                rows.append((name, ordinal, page_id, url, len(payload), sha1))
                done, ordinal = done + len(data), ordinal + 1
                if done >= ROTATE:
                    out.write(deflate.flush())
                    out = out.close()
            yield pd.DataFrame(rows, columns=["file", "ordinal", "page_id", "url", "payload_bytes", "payload_digest"])
        if out is not None:
            out.write(deflate.flush())
            out.close()

    # Ids travel as text: pandas would make a column of longs with nulls one of doubles.
    named = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    out = named.mapInPandas(write, "file string, ordinal int, page_id string, url string, payload_bytes long, payload_digest string")
    return out.withColumn("page_id", F.col("page_id").cast("long"))


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Inflate each file's one stream once, write every record as its own member, and a sidecar index beside it.

    files: file, revisits (array of ordinal, refers_to and refers_url). The index has a line of JSON per record, the archive's
    own included: offset, length, type, and of pages the id, URI and digest.
    """

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _open_store(folder)
        for batch in batches:
            for name, revisits in zip(batch["file"], batch["revisits"], strict=True):
                again = {} if revisits is None else {r["ordinal"]: (r["refers_to"], r["refers_url"]) for r in revisits}
                target = name.replace("crawl-", f"archive-{uuid.uuid4().hex[:8]}-")
                offset, index = 0, io.StringIO()

                def add(out, data: bytes, **entry) -> None:
                    nonlocal offset
                    out.write(member := gzip.compress(data, 6, mtime=0))
                    index.write(json.dumps({"offset": offset, "length": len(member), **entry}) + "\n")  # noqa: B023
                    offset += len(member)

                with store.open_input_stream(posixpath.join(root, name), compression=None) as raw, store.open_output_stream(posixpath.join(root, target), compression=None) as out:
                    add(out, info(target), type="warcinfo")
                    for ordinal, (head, payload) in enumerate(read_records(io.BufferedReader(gzip.GzipFile(fileobj=raw)))):
                        page_id, url, sha1 = head.get("X-Page-Id"), head.get("WARC-Target-URI"), head["WARC-Payload-Digest"].removeprefix("sha1:")
                        revisit = ordinal in again
                        data = record(page_id, url, payload, sha1, *again.get(ordinal, (None, None)), revisit)
                        add(out, data, type="revisit" if revisit else "response", page_id=page_id, url=url, digest=sha1)
                with store.open_output_stream(posixpath.join(root, f"{target}.idx"), compression=None) as out:
                    out.write(index.getvalue().encode())
                yield pd.DataFrame({"archive": [target]})

    return files.mapInPandas(rewrite, "archive string")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """A row for each record, each member found by the index and checked against its digest."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _open_store(folder)
        for name in (n for batch in batches for n in batch["archive"]):
            with store.open_input_stream(posixpath.join(root, f"{name}.idx"), compression=None) as f:
                spots = [(e["offset"], e["length"]) for line in f.read().splitlines() if (e := json.loads(line))["type"] != "warcinfo"]
            rows = []
            with store.open_input_file(posixpath.join(root, name)) as f:
                for offset, length in spots:
                    f.seek(offset)
                    [(head, payload)] = read_records(io.BytesIO(gzip.decompress(f.read(length))))
                    sha1, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                    if kind == "response" and digest(payload) != sha1:
                        raise ValueError(f"{name} at {offset}: the payload does not match its digest")
                    size = int(head["X-Payload-Length"]) if kind == "revisit" else len(payload)
                    rows.append((head.get("X-Page-Id"), size, sha1, kind, head.get("X-Refers-To-Page-Id")))
            yield pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    out = archives.mapInPandas(read, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return out.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def archive_pages(pages: DataFrame, revisit_from: int = 0, folder: str | None = None) -> DataFrame:
    """Archive all pages and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Of records with equal payloads of at least `revisit_from` bytes, the one with the smallest page_id (null ids
    last; of repeated rows, one) is the response and the others revisit it. Null html: an empty payload. A very long
    page is one record, held whole by its task; an empty table gives no rows; other columns are ignored.
    """
    folder = folder or shared_dir(pages.sparkSession)
    written = materialise(write_crawl(pages, folder))
    order = F.struct(F.col("page_id").isNull().alias("missing"), "page_id", "file", "ordinal", "url")
    groups = written.filter(F.col("payload_bytes") >= revisit_from).groupBy("payload_digest").agg(F.min(order).alias("kept"), F.count("*").alias("n"))
    # Written first, so that the join reads plain exchanges, which AQE splits at a hot payload.
    shared = materialise(groups.filter("n > 1").select("payload_digest", "kept"))
    same = written.join(shared, "payload_digest").filter((F.col("file") != F.col("kept.file")) | (F.col("ordinal") != F.col("kept.ordinal")))
    revisits = same.groupBy("file").agg(F.collect_list(F.struct("ordinal", F.col("kept.page_id").cast("string").alias("refers_to"), F.col("kept.url").alias("refers_url"))).alias("revisits"))
    files = written.select("file").distinct().join(revisits, "file", "left")
    tasks = max(1, files.sparkSession.sparkContext.defaultParallelism)
    archives = materialise(normalise(files.repartition(tasks * 4, "file"), folder))
    return read_archives(archives.repartition(tasks * 4, "archive"), folder)
