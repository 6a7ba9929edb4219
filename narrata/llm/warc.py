"""WARC archives in Zstandard frames: a writer, and a reader that checks what it reads.

An archive is a skippable frame that holds the dictionary, then one frame per record. Records with the payload of
another record are written as revisits of it, without a payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import spread_join, stash

#: The skippable frame that holds a dictionary, as the format for Zstandard WARC files has it, and a frame of Zstandard.
DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
VERSION = "WARC/1.1"
#: Bytes of payloads that go into one archive; documents from which its dictionary is trained, of which so many bytes each.
ARCHIVE_BYTES, DICT_SAMPLES, DICT_SAMPLE_BYTES, DICT_BYTES = 16 << 20, 200, 1 << 14, 1 << 14
#: Largest record and dictionary that the reader takes, in bytes; a larger record gives an error of its own, and the next ones are read.
MAX_RECORD, MAX_DICTIONARY = 1 << 30, 1 << 24
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


#: Digests that records are checked by, where they name them (fixed values); the only header that may repeat.
DIGESTS = {"sha1": hashlib.sha1, "sha256": hashlib.sha256, "md5": hashlib.md5}
MAY_REPEAT = "warc-concurrent-to"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


class BadArchive(ValueError):
    """An archive that can't be read on."""


class BadRecord(BadArchive):
    """A record that isn't as the format has it, or as its own headers say."""


@dataclass
class Record:
    """headers by their names in lower case; block: all that follows them; payload: the block without an HTTP head."""

    headers: dict[str, str]
    block: bytes
    payload: bytes


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value: object) -> str:
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def encode_record(page_id: object, url: str, payload: bytes, refers_to: object = None) -> bytes:
    revisit = refers_to is not None
    digest = payload_digest(payload)
    headers = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<urn:page:{page_id}>", "WARC-Date": DATE,
        "WARC-Target-URI": _line(url), "WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": len(payload),
    }
    block = b"" if revisit else payload
    if revisit:
        headers |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": REVISIT_PROFILE}
    else:
        headers |= {"WARC-Block-Digest": f"sha1:{digest}", "Content-Type": "text/html; charset=utf-8"}
    headers["Content-Length"] = len(block)
    head = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from some payloads, or no bytes where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def encode_archive(records: list[bytes], dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=3).compress(dictionary) if dictionary else b""
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    compressor = zstandard.ZstdCompressor(level=3, dict_data=shared, write_checksum=True)
    return struct.pack("<II", DICT_MAGIC, len(packed)) + packed + b"".join(map(compressor.compress, records))


def parse_headers(head: bytes) -> dict[str, str]:
    """Names in lower case, values stripped. A line that begins with white space goes on with the one before."""
    try:
        lines = head.decode("utf-8").split("\r\n")
    except UnicodeDecodeError as e:
        raise BadRecord("headers aren't UTF-8") from e
    if not lines[0].startswith("WARC/1."):
        raise BadRecord("no version line")
    headers: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            headers[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        last = name.lower()
        if not colon or not name or name != name.strip() or (last in headers and last != MAY_REPEAT):
            raise BadRecord(f"bad header line {line[:80]!r}")
        headers[last] = f"{headers[last]}, {value.strip()}" if last in headers else value.strip()
    for name in REQUIRED:
        if name.lower() not in headers:
            raise BadRecord(f"no {name}")
    return headers


def check_digest(told: str | None, data: bytes, what: str) -> None:
    """told: algorithm and value, in base 32 or hexadecimal; algorithms that aren't known here pass."""
    name, _, value = (told or "").partition(":")
    if name.lower() not in DIGESTS:
        return
    digest = DIGESTS[name.lower()](data).digest()
    if value.upper().rstrip("=") not in (base64.b32encode(digest).decode().rstrip("="), digest.hex().upper()):
        raise BadRecord(f"the {what} isn't that of its digest")


def parse_record(raw: bytes) -> Record:
    """Checks the version line, the headers, the length, the end and the digests of a record of any type."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap:
        raise BadRecord("headers don't end")
    headers = parse_headers(head)
    length = headers["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise BadRecord("the length isn't that of the header")
    block = rest[:-4]
    check_digest(headers.get("warc-block-digest"), block, "block")
    payload = block
    if headers.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        _, _, payload = block.partition(b"\r\n\r\n")
    if headers["warc-type"] != "revisit":  # its digest is that of the other record's payload
        check_digest(headers.get("warc-payload-digest"), payload, "payload")
        told = headers.get("x-payload-length", str(len(payload)))
        if not told.isdigit() or int(told) != len(payload):
            raise BadRecord("the payload isn't as long as told")
    elif "warc-profile" not in headers:
        raise BadRecord("a revisit without a profile")
    return Record(headers, block, payload)


def read_frames(data: bytes) -> Iterator[bytes | None]:
    """What each frame of an archive holds: the dictionary is in its leading skippable frame, then a frame for each record.

    Of a frame that holds more than MAX_RECORD bytes, None comes. One that is cut off or damaged ends the archive with an error.
    """
    if len(data) < 8:
        raise BadArchive("no leading frame")
    magic, size = struct.unpack_from("<II", data)
    if magic != DICT_MAGIC or len(data) < 8 + size:
        raise BadArchive("no dictionary frame in front")
    held = data[8 : 8 + size]
    try:
        if held[:4] == struct.pack("<I", FRAME_MAGIC):
            held = zstandard.ZstdDecompressor().decompress(held, max_output_size=MAX_DICTIONARY)
        shared = zstandard.ZstdCompressionDict(held) if held else None
    except zstandard.ZstdError as e:
        raise BadArchive(f"no dictionary: {e}") from e
    decompressor = zstandard.ZstdDecompressor(dict_data=shared)
    view = memoryview(data)
    at = 8 + size
    while at < len(data):
        frame = decompressor.decompressobj()
        out, fed, made = [], 0, 0
        while not frame.eof:
            piece = view[at + fed : at + fed + (1 << 12)]
            if not piece:
                raise BadArchive("the last frame is cut off")
            try:
                out.append(frame.decompress(piece))
            except zstandard.ZstdError as e:
                raise BadArchive(str(e)) from e
            made += len(out[-1])
            if made > MAX_RECORD:
                out.clear()  # the frame is read on to its end, so that the next one is found
            fed += len(piece)
        at += fed - len(frame.unused_data)
        yield b"".join(out) if made <= MAX_RECORD else None


def _parsed(raw: bytes | None) -> Record:
    if raw is None:
        raise BadRecord("a record is too large")
    return parse_record(raw)


def read_archive(data: bytes) -> Iterator[Record]:
    """The records of an archive; the first one that is bad raises an error."""
    return map(_parsed, read_frames(data))


def read_leniently(data: bytes) -> Iterator[tuple[Record | None, str | None]]:
    """(record, None) or (None, error): bad records are passed over, and where frames can't be read on, the archive ends."""
    try:
        for raw in read_frames(data):
            try:
                yield _parsed(raw), None
            except BadRecord as e:
                yield None, str(e)
    except BadArchive as e:
        yield None, str(e)


def write_archives(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """archive binary: the pages' records, dealt out over archives of about ARCHIVE_BYTES of payload each."""
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")
    ).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    groups = rows.filter(F.octet_length("html") >= least).groupBy(F.col("sha").alias("_sha")).agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n"))
    groups = groups.filter("_n > 1").drop("_n")
    # Only rows of the least size have groups, and shorter payloads have other digests.
    marked = spread_join(rows, groups, F.col("sha"), "_sha").select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("_last")), F.col("_last")).alias("refers_to")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def closed() -> pa.RecordBatch:
            samples = [r[2][:DICT_SAMPLE_BYTES] for r in held[:DICT_SAMPLES]]
            data = encode_archive([encode_record(*r) for r in held], train_dictionary(samples))
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["archive"])

        for b in batches:
            for page, url, html, ref in zip(*(b[c].to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                payload = html.encode()
                held.append((page, url, payload, ref))
                size += len(payload) + 200
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    held, size = [], 0
        if held:
            yield closed()

    return marked.mapInArrow(write, "archive binary")


def read_records(archives: DataFrame, col: str = "archive") -> DataFrame:
    """A row for every record in the column of archives: record_type, record_id, url, payload_bytes, payload_digest,
    refers_to, payload, error. Of a bad record, all but error is null.

    For archives that lie as files, archives is spark.read.format("binaryFile").load(path), col "content".
    """
    names = ["record_type", "record_id", "url", "payload_bytes", "payload_digest", "refers_to", "payload", "error"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            for data in b[col]:
                if data.as_py() is None:
                    continue
                rows: list[tuple] = []
                size = 0
                for r, error in read_leniently(data.as_py()):
                    if r is None:
                        rows.append((*[None] * 7, error))
                        continue
                    h = r.headers
                    rows.append((
                        h["warc-type"], h["warc-record-id"].strip("<>"), h.get("warc-target-uri"), int(h.get("x-payload-length", len(r.payload))),
                        h.get("warc-payload-digest", "").removeprefix("sha1:") or None, h.get("warc-refers-to", "").strip("<>") or None, r.payload, None,
                    ))
                    size += len(r.payload)
                    if size > 4 << 20:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    kind = "record_type string, record_id string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary, error string"
    return archives.select(col).mapInArrow(read, kind)


def round_trip(pages: DataFrame, least: int = 0, **names: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from archives written for pages.

    A null html is an empty payload, which is equal to other empty ones; a null url is ''. Repeated ids have a record
    each; of equal payloads, all records with the largest id are responses. A null id is written as 'None', is
    smaller than any other, so that it is a response only where all ids of its group are null, and comes back null. Extra columns are ignored. No pages, no rows.
    """
    archives = stash(write_archives(pages, least, **names), "warc")
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) AS bigint)")
    # What was just written must be readable: an error here ends the job.
    records = read_records(archives).withColumn("record_type", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("record_type")))
    return records.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )
