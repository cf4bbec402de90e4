"""WARC archives compressed as Zstandard, one frame per record, with a dictionary in the file.

File layout: a skippable frame (magic ``0x184D2A5D``) that holds the dictionary, then one frame
per record, with an empty skippable frame, which readers of the format pass over, between any two. Spark's text
writer lays the files down, one for each of its rows, so that its commit protocol covers lost
executors and any file system it knows; the line separator it must write is such an empty frame.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import bound_batches, new_path

DICT_MAGIC = 0x184D2A5D
SKIP_LOW, SKIP_HIGH = 0x184D2A50, 0x184D2A5F
FRAME_MAGIC = 0xFD2FB528
EMPTY_SKIP = "P*M\x18\x00\x00\x00\x00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("offset", T.LongType()),
    ]
)


def train(pages: DataFrame, payload_col: str, pages_most: int = 1000, bytes_most: int = 16384, size: int = 65536) -> bytes:
    """A compression dictionary from at most ``pages_most`` payloads, cut at ``bytes_most``; it may be empty.

    It affects how small the archives get and nothing else.
    """
    body = F.col(payload_col)
    hashes = pages.select(F.xxhash64(body).alias("h")).filter("h IS NOT NULL").distinct().orderBy("h").limit(pages_most)
    cut = F.substring(body, 1, bytes_most).alias("s")
    chosen = pages.select(F.xxhash64(body).alias("h"), cut).filter("length(s) > 0").join(F.broadcast(hashes), "h")
    rows = chosen.groupBy("h").agg(F.min("s").alias("s")).orderBy("h").collect()
    samples = [r.s.encode() for r in rows]
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples for the trainer: they are the dictionary
        return b"".join(samples)[-size:]


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One uncompressed WARC record."""
    head = HTTP_HEAD.format(len(payload)).encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{_text(page_id)}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _text(page_id: int | None) -> str:
    return "null" if page_id is None else str(page_id)


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def with_originals(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int = 100) -> DataFrame:
    """(page_id, url, payload binary, digest, refers_to): ``refers_to`` names the page whose payload this one repeats.

    Of pages with equal payloads of at least ``least`` bytes the smallest id is the original
    and every row that carries it has a null ``refers_to``; a group of null ids only has none. Smaller payloads have no original,
    and are dealt by their page and not by their digest, so that many empty ones do not meet in a task.
    """
    text = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), text.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= least
    firsts = base.filter(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    keyed = base.withColumn("__key", F.when(large, F.col("digest")).otherwise(F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), F.col("url"), F.lit("")))))
    joined = keyed.join(firsts.withColumnRenamed("digest", "__digest").hint("merge"), F.col("__key") == F.col("__digest"), "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, level: int = 3, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = 16 << 20) -> None:
    """Writes a record per row of ``pages`` to archives below ``path``; null payloads are empty.

    Payloads of at least ``least`` bytes that repeat an earlier page's become revisit records.
    Rows that share an id each get a record. Ids must be integers. An archive is closed once it has
    ``archive_bytes``, so that readers may hold one whole. An empty table gives no archive with records.
    """
    bound_batches(pages.sparkSession)
    words = train(pages, payload_col)
    lead = struct.pack("<II", DICT_MAGIC, len(words)) + words if words else b""
    gap = EMPTY_SKIP.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(words), write_checksum=True, write_content_size=True)
        whole = lambda parts: pa.RecordBatch.from_arrays([pa.array([gap.join(parts)], pa.binary())], ["archive"])
        parts, held = [lead] if lead else [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.append(pack.compress(record(*row, date)))
                held += len(parts[-1])
                if held >= archive_bytes:
                    yield whole(parts)
                    parts, held = [lead] if lead else [], 0
        if held:
            yield whole(parts)

    rows = with_originals(pages, id_col, url_col, payload_col, least)
    archives = rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "archive binary")
    plain = archives.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", EMPTY_SKIP).option("compression", "none")
    plain.option("maxRecordsPerFile", 1).text(path)


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends; raises ``ValueError`` if it is cut short."""
    try:
        flags = data[at + 4]
        single = flags >> 5 & 1
        end = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (1 if single and not flags >> 6 else (0, 2, 4, 8)[flags >> 6])
        last = False
        while not last:
            head = int.from_bytes(data[end : end + 3], "little")
            last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
            if kind == 3 or end + 3 > len(data):
                raise ValueError(f"damaged block at byte {end}")
            end += 3 + (1 if kind == 1 else size)
    except IndexError:
        raise ValueError(f"frame at byte {at} is cut short") from None
    end += 4 * (flags >> 2 & 1)
    if end > len(data):
        raise ValueError(f"frame at byte {at} is cut short")
    return end


def frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of each record frame of an archive."""
    view, at = memoryview(data), 0
    unpack = zstandard.ZstdDecompressor()
    while at < len(view):
        if at + 8 > len(view):
            raise ValueError(f"{len(view) - at} stray bytes at byte {at}")
        magic, size = struct.unpack_from("<II", view, at)
        if SKIP_LOW <= magic <= SKIP_HIGH:
            if at + 8 + size > len(view):
                raise ValueError(f"skippable frame at byte {at} is cut short")
            if magic == DICT_MAGIC and at == 0:
                words = bytes(view[8 : 8 + size])
                if words[:4] == struct.pack("<I", FRAME_MAGIC):
                    words = zstandard.ZstdDecompressor().decompress(words)
                unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(words))
            at += 8 + size
        elif magic == FRAME_MAGIC:
            end = frame_end(view, at)
            try:
                out = unpack.decompress(bytes(view[at:end]), max_output_size=1 << 31)
            except zstandard.ZstdError as error:
                raise ValueError(f"frame at byte {at}: {error}") from None
            yield at, out
            at = end
        else:
            raise ValueError(f"no frame at byte {at}")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one record; raises ``ValueError`` unless it is whole."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name.lower() in headers:
            raise ValueError(f"bad header line {line[:80]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not headers.get(name):
            raise ValueError(f"header {name} is missing")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"content-length {headers['content-length']} does not fit a block of {len(rest) - 4} bytes")
    return headers, rest[:-4]


def _page(name: str | None) -> int | None:
    if name is None:
        return None
    if not name.startswith("<urn:page:") or not name.endswith(">"):
        raise ValueError(f"record id {name!r}")
    return None if name[10:-1] == "null" else int(name[10:-1])


def payload_of(headers: dict[str, str], block: bytes) -> tuple[bytes | None, int, str]:
    """(payload, its length, its SHA-256); a revisit's payload is None, its length and digest as stated."""
    head, gap, body = block.partition(b"\r\n\r\n")
    lengths = [line.split(b":", 1)[1].strip() for line in head.split(b"\r\n")[1:] if line.lower().startswith(b"content-length:")]
    kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "")
    if not gap or not head.startswith(b"HTTP/") or len(lengths) != 1 or not digest.startswith("sha256:"):
        raise ValueError("no HTTP header, length or digest")
    if kind == "revisit":
        if body or "warc-refers-to" not in headers:
            raise ValueError("a revisit record with a body or without its original")
        return None, int(lengths[0]), digest[7:]
    if kind != "response":
        raise ValueError(f"record type {kind!r}")
    if len(body) != int(lengths[0]):
        raise ValueError(f"payload of {len(body)} bytes, not {int(lengths[0])}")
    if hashlib.sha256(body).hexdigest() != digest[7:]:
        raise ValueError("payload does not fit its digest")
    return body, len(body), digest[7:]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``, as ``RECORDS``; a damaged archive raises with file and byte."""
    bound_batches(spark)
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("file", pa.string()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                try:
                    for at, data in frames(content.as_buffer().to_pybytes()):
                        headers, block = parse(data)
                        payload, size, digest = payload_of(headers, block)
                        key = headers["warc-record-id"]
                        rows.append((_page(key), headers["warc-type"], key, _page(headers.get("warc-refers-to")), headers.get("warc-target-uri"), payload, size, digest, name, at))
                        held += len(block) + 500
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                except ValueError as error:
                    raise ValueError(f"{name}: {error}") from None
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, RECORDS)


def checked(records: DataFrame) -> DataFrame:
    """``records`` (without payloads), each revisit held against the response it names: another length or digest, or none, raises.

    ``records`` has the columns page_id, record_type, refers_to, payload_bytes and payload_digest, of which the last two must fit.
    """
    named = records.filter("record_type = 'response'").select(F.col("page_id").alias("__page"), F.col("payload_bytes").alias("__bytes"), F.col("payload_digest").alias("__digest")).distinct()
    fits = (F.col("payload_bytes") == F.col("__bytes")) & (F.col("payload_digest") == F.col("__digest"))
    revisits = records.filter("record_type = 'revisit'")
    joined = revisits.join(named.hint("merge"), (F.col("refers_to") == F.col("__page")) & fits, "left")
    bad = F.raise_error(F.concat(F.lit("no response that fits the revisit record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    kept = joined.withColumn("payload_digest", F.when(F.col("__page").isNull(), bad).otherwise(F.col("payload_digest"))).select(*records.columns)
    return records.filter("record_type = 'response'").unionByName(kept)


def round_trip(pages: DataFrame, **how) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads their records back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, **how)
    return read_archives(pages.sparkSession, path)
