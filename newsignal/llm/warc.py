"""WARC archives in Zstandard frames with a shared dictionary: writer and validating reader."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsignal.session import materialise, shared_folder

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

SUFFIX = ".warc.zst"
# A record header that has not ended by then is damaged.
LONGEST_HEADER = 1 << 20
RECORD = (
    "archive string, number long, record_id string, record_type string, target_uri string, date string, "
    "payload_digest string, payload_bytes long, refers_to string, payload binary, headers map<string, string>, "
    "error string"
)


class WarcError(ValueError):
    """A frame or a record that breaks the format."""


def header_value(text: str) -> str:
    """Control characters, blanks and non-ASCII characters percent-encoded."""
    return quote(text, safe="!#$%&'()*+,/:;=?@[]~-._|")


def pack(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers)
    return VERSION + b"\r\n" + lines.encode("ascii") + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(key: str, url: str, date: str, payload: bytes, first: str | None) -> bytes:
    """A response record, or with `first`, the key of the response, a revisit of it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    headers = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{header_value(key)}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", header_value(url) or f"urn:page:{header_value(key)}"),
        ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest()),
        ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if first is not None:
        headers += [("WARC-Refers-To", f"<urn:page:{header_value(first)}>"), ("WARC-Profile", REVISIT_PROFILE)]
    return pack(headers, block)


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading skippable frame: its content is the dictionary, compressed."""
    body = zstd.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def load_dictionary(stream: io.BufferedIOBase) -> zstd.ZstdCompressionDict | None:
    """The dictionary of an archive, plain or compressed; the stream then stands at the first record."""
    start = stream.tell()
    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != SKIPPABLE_MAGIC:
        stream.seek(start)
        return None
    size = struct.unpack("<I", head[4:])[0]
    body = stream.read(size)
    if len(body) < size:
        raise WarcError("the dictionary frame is cut off")
    if body[:4] == FRAME_MAGIC:
        try:
            body = zstd.ZstdDecompressor().decompressobj().decompress(body)
        except zstd.ZstdError as error:
            raise WarcError(f"the dictionary cannot be read: {error}") from error
    if body[:4] != DICTIONARY_MAGIC:
        raise WarcError("the leading frame holds no dictionary")
    return zstd.ZstdCompressionDict(body)


def frames(stream: io.BufferedIOBase, dictionary: zstd.ZstdCompressionDict | None) -> Iterator[bytes]:
    """One decoded frame after the other; skippable frames between them are passed over."""
    decompressor = zstd.ZstdDecompressor(dict_data=dictionary) if dictionary else zstd.ZstdDecompressor()
    held = stream.read(1 << 16)
    while held:
        while len(held) < 8 and (more := stream.read(1 << 16)):
            held += more
        magic = struct.unpack("<I", held[:4])[0] if len(held) >= 4 else 0
        if magic & 0xFFFFFFF0 == 0x184D2A50 and len(held) >= 8:
            left = 8 + struct.unpack("<I", held[4:8])[0]
            while len(held) < left:
                left -= len(held)
                held = stream.read(1 << 16)
                if not held:
                    raise WarcError("a skippable frame is cut off")
            held = held[left:] or stream.read(1 << 16)
            continue
        frame, out = decompressor.decompressobj(), []
        while True:
            try:
                out.append(frame.decompress(held))
            except zstd.ZstdError as error:
                raise WarcError(f"a frame cannot be decoded: {error}") from error
            if frame.eof:
                held = frame.unused_data or stream.read(1 << 16)
                break
            held = stream.read(1 << 16)
            if not held:
                raise WarcError("a frame is cut off")
        yield b"".join(out)


def parse(record: bytes) -> dict:
    """The fields of one record; raises WarcError where a header or a length is wrong."""
    end = record.find(b"\r\n\r\n", 0, LONGEST_HEADER)
    if end < 0:
        raise WarcError("the header does not end")
    lines = record[:end].split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise WarcError("the version line is wrong")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise WarcError("a header line has no name")
        headers[name.decode().lower()] = value.strip().decode("utf-8", "replace")
    for name in REQUIRED:
        if not headers.get(name):
            raise WarcError(f"{name} is missing")
    if not re.fullmatch(r"[0-9]{1,18}", headers["content-length"]):
        raise WarcError("content-length is no number")
    size, block = int(headers["content-length"]), record[end + 4 : -4]
    if len(block) != size or record[-4:] != b"\r\n\r\n" or len(record) < end + 8:
        raise WarcError(f"content-length is {size}, the block has {len(block)} bytes")
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha256:") and digest[7:] != hashlib.sha256(block).hexdigest():
        raise WarcError("the block digest is wrong")
    payload, payload_bytes = None, None
    digest = headers.get("warc-payload-digest", "")
    if headers.get("content-type", "").startswith("application/http"):
        http_end = block.find(b"\r\n\r\n")
        if http_end < 0:
            raise WarcError("the HTTP header does not end")
        length = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", block[: http_end + 2])
        payload_bytes = int(length[1]) if length else None
        if headers["warc-type"] != "revisit":
            payload = block[http_end + 4 :]
            if payload_bytes is not None and payload_bytes != len(payload):
                raise WarcError(f"the HTTP length is {payload_bytes}, the payload has {len(payload)} bytes")
            payload_bytes = len(payload)
            if digest.startswith("sha256:") and digest[7:] != hashlib.sha256(payload).hexdigest():
                raise WarcError("the payload digest is wrong")
    return {
        "record_id": headers["warc-record-id"].strip("<>"),
        "record_type": headers["warc-type"],
        "target_uri": headers.get("warc-target-uri"),
        "date": headers["warc-date"],
        "payload_digest": digest.removeprefix("sha256:") or None,
        "payload_bytes": payload_bytes,
        "refers_to": headers["warc-refers-to"].strip("<>") if "warc-refers-to" in headers else None,
        "payload": payload,
        "headers": list(headers.items()),
        "error": None,
    }


def read_stream(name: str, stream: io.BufferedIOBase) -> Iterator[dict]:
    """All records of an archive. Damage gives a row with `error`; after a broken frame nothing can follow."""
    nothing = dict.fromkeys(
        ["record_id", "record_type", "target_uri", "date", "payload_digest", "payload_bytes", "refers_to", "payload", "headers"]
    )
    number = 0
    try:
        for record in frames(stream, load_dictionary(stream)):
            try:
                row = parse(record)
            except WarcError as error:
                row = nothing | {"error": str(error)}
            yield {"archive": name, "number": number} | row
            number += 1
    except WarcError as error:
        yield {"archive": name, "number": number} | nothing | {"error": str(error)}


def arrow_rows(rows: Iterable[dict], bound: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of records that hold some `bound` bytes of payload."""
    schema = pa.schema(
        [("archive", pa.string()), ("number", pa.int64())]
        + [(c, pa.string()) for c in ("record_id", "record_type", "target_uri", "date", "payload_digest")]
        + [("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())]
        + [("headers", pa.map_(pa.string(), pa.string())), ("error", pa.string())]
    )
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row["payload"] or b"") + 500
        if size >= bound:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return pafs.FileSystem.from_uri(folder)


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of archives, given as rows `path`, with the columns of RECORD.

    Each archive is read as a stream by one task, frame by frame.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, place = store(path)
                with files.open_input_file(place) as stream:
                    yield from arrow_rows(read_stream(path, stream))

    return archives.select("path").mapInArrow(read, RECORD)


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives below a folder that Spark can read, with the columns of RECORD."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*" + SUFFIX).option("recursiveFileLookup", "true")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from arrow_rows(read_stream(path, io.BytesIO(content.as_py())))

    return found.load(folder).select("path", "content").mapInArrow(read, RECORD)


def checked(records: DataFrame) -> DataFrame:
    """`records`; a damaged one fails the query."""
    problem = F.concat_ws(" ", F.lit("damaged archive"), "archive", F.lit("record"), "number", "error")
    kind = F.when(F.col("error").isNotNull(), F.raise_error(problem).cast("string")).otherwise(F.col("record_type"))
    return records.withColumn("record_type", kind)


def with_duplicates(pages: DataFrame, least: int) -> DataFrame:
    """id, url, payload, first: the smallest id with the same payload, NULL where that is this record's own.

    Only payloads that occur more than once are looked up, by digest; large
    payloads cross no shuffle where those are few.
    """
    keyed = pages.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    firsts = materialise(
        keyed.where((F.length("payload") >= least) & F.col("id").isNotNull())
        .groupBy("digest")
        .agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    return keyed.join(firsts, "digest", "left").select(
        "id", "url", "payload", F.when(F.col("id") != F.col("first"), F.col("first")).alias("first")
    )


def train_dictionary(pages: DataFrame, sample: int, size: int) -> bytes:
    """A dictionary of `size` bytes from at most `sample` pages, spread evenly; empty if they are too few."""
    total = pages.count()
    texts = [
        bytes(r.payload)
        for r in pages.where(F.pmod(F.xxhash64("payload"), F.lit(max(1, total // sample))) == 0)
        .select(F.substring("payload", 1, 16384).alias("payload"))
        .limit(sample)
        .collect()
    ]
    try:
        return zstd.train_dictionary(size, sorted(texts)).as_bytes()
    except zstd.ZstdError:
        return b""


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least: int = 100,
    archive_bytes: int = 256 << 20,
    date: str = "1970-01-01T00:00:00Z",
    dictionary_sample: int = 500,
    dictionary_bytes: int = 32 << 10,
) -> DataFrame:
    """Writes one record per row below `folder`; returns path and records of each archive.

    Of records with equal payloads of at least `least` bytes the one with the
    smallest id is a response and the others are revisits of it. Repeated rows
    of the smallest id are responses. A NULL payload is empty; a NULL id is
    written as an empty key and never refers to another record. A NULL url is
    replaced by the record's id.

    An archive is closed at `archive_bytes`. A task writes under names of its
    own and reports them when it ends, so a lost task leaves files that no row
    of the result names. The dictionary is trained on at most
    `dictionary_sample` pages of at most 16 KB each.
    """
    plain = pages.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"),
    )
    dictionary = train_dictionary(plain, dictionary_sample, dictionary_bytes)
    folder = folder.rstrip("/")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, place = store(folder)
        files.create_dir(place, recursive=True)
        shared = zstd.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstd.ZstdCompressor(level=3, dict_data=shared, write_content_size=True)
        paths, counts = [], []
        stream, written = None, 0
        for batch in batches:
            for key, url, payload, first in zip(*(c.to_pylist() for c in batch.columns)):
                if stream is None or written >= archive_bytes:
                    if stream is not None:
                        stream.close()
                    name = f"{uuid.uuid4().hex}{SUFFIX}"
                    stream, written = files.open_output_stream(f"{place}/{name}", compression=None), 0  # no second compression
                    paths.append(f"{folder}/{name}")
                    counts.append(0)
                    if dictionary:
                        written += stream.write(dictionary_frame(dictionary))
                record = page_record("" if key is None else str(key), url, date, payload, None if first is None else str(first))
                written += stream.write(compressor.compress(record))
                counts[-1] += 1
        if stream is not None:
            stream.close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], ["path", "records"])

    return materialise(with_duplicates(plain, least).mapInArrow(write, "path string, records long"))


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
