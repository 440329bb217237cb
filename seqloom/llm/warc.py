"""WARC archives with Zstandard: writer, and reader for the dictionary format.

An archive is a skippable frame that holds the dictionary, then one zstd frame for each record.
The reader takes archives as rows (name, content), which is what the binaryFile source gives for
files, and what archives() below makes. Archives stay tables of bounded binary rows in whatever
store Spark writes to: no task opens a local path, and a lost executor's archives are made again.

Deduplication. Among records whose payloads of MIN_REVISIT bytes or more are equal (SHA-1 and
length), that with the largest page_id is the response and the others revisit it. The largest
page_id of each digest is a grouped maximum with partial aggregation, and digests that occur once
never leave it. Repeated ones come back as a broadcast while they are under BROADCAST_ROWS, so payloads
do not move; beyond that, digests of HOT records or more are few enough for it, and rows of the others are
joined by a shuffle in which no digest has HOT rows. Payloads too short to repeat are never joined.

Defined results: null html is an empty payload; rows with equal page_id and payload, if theirs is
the largest, are all responses; a null page_id never is the one referred to, and where a group has
no other its records are all responses; payloads of any length are kept whole; an empty table
gives no archive and an empty result; other columns are not read. A frame, header or length that
does not hold raises WarcError and fails the read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import Scratch
from .joins import BROADCAST_ROWS

#: Zstandard's frame marks, the one the format takes for the dictionary, and WARC's fixed strings.
ZSTD_MAGIC, DICT_FRAME = 0xFD2FB528, 0x184D2A5D
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

MIN_REVISIT, HOT = 1000, 10_000
#: Compressed bytes of an archive, bytes of its dictionary, and of records it is trained on.
ARCHIVE_BYTES, DICT_BYTES, TRAIN_BYTES = 8_000_000, 32_768, 1_000_000


class WarcError(ValueError):
    """An archive that breaks the format."""


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(record_id: str) -> int | None:
    if not (record_id.startswith("<urn:page:") and record_id.endswith(">")):
        raise WarcError(f"record id {record_id!r}")
    return int(record_id[10:-1]) if record_id[10:-1] else None


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def format_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit without its payload if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": "".join((url or "").split()),
        "WARC-Payload-Digest": _sha1(payload),
        "WARC-Block-Digest": _sha1(block),
        "Content-Type": "application/http;msgtype=response",
    }
    if refers_to is not None:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": _record_id(refers_to)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v)
    return VERSION + b"\r\n" + lines.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _fields(lines: list[bytes], of: str) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise WarcError(f"{of} line {line[:60]!r}")
        out[name.decode("ascii").strip().lower()] = value.decode("utf-8").strip()
    return out


def parse_record(data: bytes) -> dict:
    """Validates a record and returns its page_id, type, refers_to, payload (None for a revisit), digest and length."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise WarcError(f"record begins with {data[:20]!r}")
    field = _fields(lines[1:], "header")
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - field.keys():
        raise WarcError(f"headers missing: {sorted(missing)}")
    if not field["content-length"].isdigit():
        raise WarcError(f"content length {field['content-length']!r}")
    n = int(field["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"block of {len(rest) - 4} bytes; the header says {n}")
    block = rest[:n]
    if "warc-block-digest" in field and field["warc-block-digest"] != _sha1(block):
        raise WarcError("block digest does not hold")
    out = {"page_id": _page_id(field["warc-record-id"]), "record_type": field["warc-type"], "url": field.get("warc-target-uri"), "refers_to": None, "payload": None}
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = _fields(http.split(b"\r\n")[1:], "HTTP header").get("content-length", "")
    if not http.startswith(b"HTTP/1.") or not gap or not length.isdigit():
        raise WarcError("HTTP header does not hold")
    digest = field.get("warc-payload-digest", "")
    if out["record_type"] == "response":
        if len(payload) != int(length) or digest != _sha1(payload):
            raise WarcError("payload's length or digest does not hold")
        out["payload"] = payload
    elif out["record_type"] == "revisit":
        if payload or field.get("warc-profile") != REVISIT_PROFILE or "warc-refers-to" not in field or not digest.startswith("sha1:"):
            raise WarcError("revisit headers do not hold")
        out["refers_to"] = _page_id(field["warc-refers-to"])
    else:
        raise WarcError(f"record type {out['record_type']!r}")
    return out | {"payload_digest": base64.b32decode(digest[5:]).hex(), "payload_bytes": int(length)}


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary, or a raw one of the last sample bytes where there are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def write_archive(records: list[bytes]) -> bytes:
    """The bytes of an archive of one or more records."""
    import zstandard

    some, total = [], 0
    for r in records:
        some.append(r)
        if (total := total + len(r)) > TRAIN_BYTES:
            break
    raw = train_dictionary(some)
    frame = zstandard.ZstdCompressor(level=9).compress(raw)
    press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=True)
    head = DICT_FRAME.to_bytes(4, "little") + len(frame).to_bytes(4, "little") + frame
    return head + b"".join(press.compress(r) for r in records)


def read_archive(content: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    import zstandard

    at, dictionary = 0, None
    if int.from_bytes(content[:4], "little") == DICT_FRAME:
        size = int.from_bytes(content[4:8], "little")
        at = 8 + size
        raw = content[8:at]
        if len(raw) != size:
            raise WarcError("the dictionary's frame is cut off")
        if int.from_bytes(raw[:4], "little") == ZSTD_MAGIC:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    view = memoryview(content)
    while at < len(content):
        magic = int.from_bytes(content[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # another skippable frame
            at += 8 + int.from_bytes(content[at + 4 : at + 8], "little")
            continue
        if magic != ZSTD_MAGIC:
            raise WarcError(f"no zstd frame at byte {at}")
        one, parts, fed = reader.decompressobj(), [], at
        try:
            while not one.eof and fed < len(content):
                parts.append(one.decompress(view[fed : fed + 65_536]))
                fed = min(fed + 65_536, len(content))
        except zstandard.ZstdError as e:
            raise WarcError(f"frame at byte {at}: {e}") from e
        if not one.eof:
            raise WarcError(f"the frame at byte {at} is cut off")
        at = fed - len(one.unused_data)
        yield b"".join(parts)


def with_record_types(pages: DataFrame, scratch: Scratch, hot: int = HOT, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(page_id, url, payload binary, refers_to): refers_to is null for responses."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    digest = F.when(F.octet_length("payload") >= MIN_REVISIT, F.concat_ws(":", F.sha1("payload"), F.octet_length("payload")))
    rows = rows.withColumn("digest", digest)
    groups = rows.select("digest", "page_id").where("digest IS NOT NULL").groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    groups = scratch.write(groups.where("n > 1 AND kept IS NOT NULL"), "repeated")
    few = groups.limit(limit + 1).count() <= limit
    # the payloads with most copies are broadcast, as many as the limit holds; the others' copies are salted, so that no
    # join key has more than about `hot` rows
    least = hot
    while not few and groups.where(F.col("n") >= least).limit(limit + 1).count() > limit:
        least *= 2
    first, salts = (groups, 1) if few else (groups.where(F.col("n") >= least), -(-least // hot))
    joined = rows.join(F.broadcast(first.select("digest", "kept")), "digest", "left")
    if not few:
        every = F.sequence(F.lit(0), F.lit(salts - 1).cast("long"))
        rest = groups.where(F.col("n") < least).select("digest", F.col("kept").alias("other"), F.explode(every).alias("salt"))
        asks = F.col("digest").isNotNull() & F.col("kept").isNull()
        salt = F.pmod(F.xxhash64("page_id"), F.lit(salts))
        later = joined.where(asks).withColumn("salt", salt).join(rest, ["digest", "salt"], "left").withColumn("kept", F.col("other"))
        joined = joined.where(~asks).unionByName(later.select(*joined.columns))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))
    return joined.select("page_id", "url", "payload", refers.alias("refers_to"))


def archives(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(name, content): archives of bounded size, several a partition."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, 0

        def out() -> pa.RecordBatch:
            name = f"part-{TaskContext.get().partitionId():05d}-{n:05d}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([write_archive(held)], pa.binary())], ["name", "content"])

        for batch in batches:
            columns = [batch.column(k) for k in range(4)]
            for row in zip(*columns, strict=True):
                page, url, payload, refers = (x.as_py() for x in row)
                held.append(format_record(page, url, payload, refers))
                size += len(held[-1])
                if size > 4 * archive_bytes:  # before compression
                    yield out()
                    held, size, n = [], 0, n + 1
        if held:
            yield out()

    return records.select("page_id", "url", "payload", "refers_to").mapInArrow(write, "name string, content binary")


RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of archives in a column `content` (binaryFile has one). Without payloads, they are validated only."""
    names = [f.split()[0] for f in RECORDS.split(", ")]
    schema = pa.schema([(n, pa.int64() if t == "long" else pa.string() if t == "string" else pa.binary()) for n, t in (f.split() for f in RECORDS.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for data in read_archive(content.as_py()):
                    rows.append(parse_record(data))
                    if not payloads:
                        rows[-1]["payload"] = None
                    if (size := size + len(rows[-1]["payload"] or b"")) > 8_000_000 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema)

    return files.select("content").mapInArrow(read, RECORDS)


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest,
             CASE WHEN octet_length(encode(html)) >= {MIN_REVISIT} THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to FROM q
"""
