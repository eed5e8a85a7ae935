"""WARC writer with identical-payload revisits, and a salvage reader.

Writing: records go through Spark's text sink, one gzip member per record, so that any Hadoop file
system can hold the archives. A row of the sink holds members of FILE_BYTES together, or one larger member, and is
a file of its own, so a reader's task holds no more than that at once. The sink's line separator is a gzip member of
zero bytes, which every reader passes over.

Reading: a record is taken only if all its checks hold: gzip checksum and length, version line, headers,
Content-Length, the closing blank lines, and the block and payload digests (the payload of a block of type
application/http is what follows its head). After a failed check the reader searches for
the next valid member (gzip signature) or version line, takes up reading there, and logs the bytes in
between as a quarantined gap. Plain and gzip records of WARC/1.0 and 1.1 may be mixed.

Inside a member, reading is taken up at the next version line of what was inflated, and records found so
carry the member's place, as its gap does. Of a member that does not inflate or fails its checksum, what came
before the error is read as well; as the checksum then proves nothing, a record must have a block digest, and
headers of this writer (X-Page-ID) must be proved by its record id, a hash of all other headers. A member that
is only cut short is taken up to the cut.

Defined results: a null payload is written as an empty one; of records with equal payloads of at least
`min_bytes` bytes, that with the smallest page_id is the response (of repeated page_ids, all rows with
it are) and others revisit it; a null page_id is written without an id and comes last; an empty table
gives no records; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm.shared import new_path

VERSION = b"WARC/1.1"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
#: Where reading may be taken up again.
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
GZIP = b"\x1f\x8b\x08"
#: A gzip member that holds nothing; it stands between records.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
END = b"\r\n\r\n"
FILE_BYTES = 16 << 20  # of an archive, unless one record alone has more
RECORD = "archive string, offset long, length long, gap boolean, reason string, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, compress: bool = True) -> bytes:
    """One record; refers_to makes it a revisit, which carries no payload."""
    kind, block = ("response", payload) if refers_to is None else ("revisit", b"")
    heads = [("WARC-Type", kind), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        heads.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if page_id is not None:
        heads.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        heads += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", str(refers_to))]
    heads += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("X-Payload-Length", str(len(payload)))]
    heads += [("Content-Type", "text/html"), ("Content-Length", str(len(block)))]
    lines = [f"{k}: {v}".encode() for k, v in heads]
    raw = b"\r\n".join([VERSION, f"WARC-Record-ID: {_record_id(lines)}".encode(), *lines]) + END + block + END
    if not compress:
        return raw
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _record_id(lines: list[bytes]) -> str:
    """A name made of all other header lines."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, b'\r\n'.join(lines))}>"


def _parse(raw: bytes, at: int, want_payload: bool, proved: bool = True) -> tuple[dict | None, int, str]:
    """The record that starts at `at`: (record, end, reason of failure). Unless a checksum proved the bytes, digests must."""
    if not VERSION_LINE.match(raw, at):
        return None, at, "no version line"
    stop = raw.find(END, at, at + (1 << 16))
    if stop < 0:  # long headers: they end before the next version line, if there is one
        after = VERSION_LINE.search(raw, at + len(VERSION))
        stop = raw.find(END, at, after.start() if after else len(raw))
    if stop < 0:
        return None, at, "no end of headers"
    heads = {}
    lines = raw[at + len(VERSION) + 2 : stop].split(b"\r\n")
    for line in lines:
        k, sep, v = line.partition(b":")
        if not sep:
            return None, at, "bad header"
        heads[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    try:
        n = int(heads["content-length"])
        size = int(heads.get("x-payload-length", n))
        page, refers = (int(heads[h]) if h in heads else None for h in ("x-page-id", "x-refers-to-page-id"))
    except (KeyError, ValueError):
        return None, at, "bad length or id"
    lo, hi = stop + 4, stop + 4 + n
    if n < 0 or raw[hi : hi + 4] != END:
        return None, at, "record is cut short or overruns"
    block = raw[lo:hi]
    if heads.get("warc-block-digest", "") not in ("", f"sha1:{base32_sha1(block)}"):
        return None, at, "block digest differs"
    if not proved and not heads.get("warc-block-digest"):
        return None, at, "checksum fails and there is no block digest"
    if not proved and "x-page-id" in heads and heads.get("warc-record-id") != _record_id([x for x in lines if not x.startswith(b"WARC-Record-ID:")]):
        return None, at, "checksum fails and the record id does not prove the headers"
    digest, kind = heads.get("warc-payload-digest", "").removeprefix("sha1:"), heads.get("warc-type", "")
    payload = block
    if heads.get("content-type", "").partition(";")[0].strip().lower() == "application/http":
        payload = block.partition(END)[2]
        size = size if "x-payload-length" in heads else len(payload)
    if kind == "response" and digest and digest != base32_sha1(payload):
        return None, at, "payload digest differs"
    found = {"page_id": page, "record_type": kind, "payload_digest": digest, "payload_bytes": size, "refers_to": refers, "payload": payload if want_payload else None}
    return found, hi + 4, ""


class _Members:
    """Inflates the members of one archive. False signatures cost little: the next zero byte, where names in headers
    end, is looked for once, and a stream that fails is not tried again under another header that leads to it."""

    def __init__(self, raw: bytes):
        self.raw, self.zero, self.bad = raw, -1, -1

    def _after_zero(self, at: int) -> int:
        if self.zero < at:
            self.zero = self.raw.find(b"\0", at)
            if self.zero < 0:
                self.zero = len(self.raw)
        return self.zero + 1

    def data_start(self, at: int) -> int:
        """Where the deflate stream of the member at `at` starts, beyond the archive if its header does not end."""
        flags = self.raw[at + 3] if at + 3 < len(self.raw) else 0
        end = at + 10
        if flags & 4:
            end += 2 + int.from_bytes(self.raw[end : end + 2], "little")
        for _ in range((flags >> 3 & 1) + (flags >> 4 & 1)):  # name and comment
            end = self._after_zero(end)
        return end + (flags & 2)

    def __call__(self, at: int) -> tuple[bytes, int, str, bool]:
        """The member that starts at `at`: (all that inflates, end, reason of failure, whether it is only cut short)."""
        start = self.data_start(at)
        if start > len(self.raw):
            return b"", at, "member's header does not end", False
        if start == self.bad:
            return b"", at, "member does not inflate: its stream failed before", False
        plain, end, reason, cut = _inflate(self.raw, at)
        if reason and "header" not in reason:
            self.bad = start
        return plain, end, reason, cut


def _inflate(raw: bytes, at: int) -> tuple[bytes, int, str, bool]:
    """The member that starts at `at`: (all that inflates, end, reason of failure, whether it is only cut short)."""
    z, parts, fed = zlib.decompressobj(31), [], at
    try:
        while fed < len(raw) and not z.eof:  # piece by piece: what follows the member is not copied
            parts.append(z.decompress(raw[fed : fed + (1 << 14)]))
            fed = min(len(raw), fed + (1 << 14))
        return b"".join(parts), fed - len(z.unused_data), "" if z.eof else "member is cut short", not z.eof
    except zlib.error as e:
        reason = f"member does not inflate: {e}"
    z = zlib.decompressobj(31)
    for k in range(at, fed, 1 << 14):
        z.decompress(raw[k : k + (1 << 14)])
    try:
        while fed < len(raw):  # byte by byte up to the error
            parts.append(z.decompress(raw[fed : fed + 1]))
            fed += 1
    except zlib.error:
        pass
    return b"".join(parts), fed, reason, False


def _inside(plain: bytes, want_payload: bool, proved: bool) -> tuple[list[dict], str]:
    """The records of a member's text that pass every check, and the reason of the first failure."""
    found, inner, why = [], 0, ""
    while inner < len(plain):
        one, end, reason = _parse(plain, inner, want_payload, proved)
        if not reason:
            found.append(one)
            inner = end
            continue
        why = why or reason
        after = VERSION_LINE.search(plain, inner + 1)
        inner = after.start() if after else len(plain)
    return found, why


def salvage(raw: bytes, want_payload: bool = False) -> Iterator[dict]:
    """All records of an archive that pass every check, and a gap for every run of other bytes.

    The gap of a damaged member covers it whole; the records that it still gave lie inside."""
    at, bad_from, why = 0, -1, ""
    inflate = _Members(raw)
    spent, spent_to, spent_at = b"", 0, 0  # text of a damaged member, which may stand in the archive as it is

    def gap(end: int) -> dict:
        return {"offset": bad_from, "length": end - bad_from, "gap": True, "reason": why}

    while at < len(raw):
        found, end, reason, whole = [], at, "no member or version line", False
        if raw[at : at + 3] == GZIP:
            plain, end, reason, cut = inflate(at)
            whole = not reason
            found, inner = _inside(plain, want_payload, whole or cut)
            reason = reason or inner
            if reason and end > spent_to:
                spent, spent_to, spent_at = plain, end, 0
        elif VERSION_LINE.match(raw, at):
            one, end, reason = _parse(raw, at, want_payload)
            if not reason and at < spent_to and (k := spent.find(raw[at:end], spent_at)) >= 0:
                spent_at, reason = k + 1, "part of a damaged member"
            found = [one] if not reason else []
        if bad_from >= 0 and (found or not reason):
            yield gap(at)
            bad_from = -1
        for one in found:
            yield one | {"offset": at, "length": end - at, "gap": False, "reason": None}
        if not reason:
            at = end
            continue
        if bad_from < 0:
            bad_from, why = at, reason
        if whole and found:  # the member ends where it should
            yield gap(end)
            at, bad_from = end, -1
            continue
        after = START.search(raw, at + 1)
        at = after.start() if after else len(raw)
    if bad_from >= 0:
        yield gap(len(raw))


def decide(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (binary), sha1 (hex), refers_to. Groups of equal payloads are pre-aggregated to their
    smallest id; the join back is one that adaptive execution can split."""
    p = pages.withColumn("sha1", F.sha1("payload"))
    big = F.length("payload") >= min_bytes
    first = p.filter(big).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha1", "first")
    out = p.join(first, "sha1", "left")
    return out.withColumn("refers_to", F.when(big & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first"))), F.col("first"))).drop("first")


def write(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> None:
    """Archives of all pages under path, one gzip member per record."""
    p = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"))

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for f in frames:
            rows = zip(f.page_id, f.url, f.payload, f.sha1, f.refers_to, strict=True)
            whole = lambda x: None if pd.isna(x) else int(x)
            for i, u, b, s, r in rows:
                member = record(whole(i), u, bytes(b), base64.b32encode(bytes.fromhex(s)).decode(), whole(r))
                if held and size + len(member) > FILE_BYTES:
                    yield pd.DataFrame({"value": [EMPTY_MEMBER.join(held)]})
                    held, size = [], 0
                held.append(member)
                size += len(member)
        if held:
            yield pd.DataFrame({"value": [EMPTY_MEMBER.join(held)]})

    done = decide(p, min_bytes).select(F.col("page_id").cast("string"), "url", "payload", "sha1", F.col("refers_to").cast("string"))
    binary = done.mapInPandas(members, "value binary").select(F.col("value").cast("string"))
    binary.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def read(spark: SparkSession, path: str, want_payload: bool = False) -> DataFrame:
    """Every record and every gap of the archives under path (RECORD)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content")

    def rows(batches):
        import pyarrow as pa

        for b in batches:
            for name, content in zip(b.column("path"), b.column("content"), strict=True):
                found = []
                for one in salvage(content.as_py(), want_payload):
                    found.append({"archive": name.as_py()} | {c: one.get(c) for c in columns})
                    if len(found) >= 500:
                        yield pa.RecordBatch.from_pylist(found, schema)
                        found = []
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema)

    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RECORD.split(", ")])
    columns = schema.names[1:]
    return files.mapInArrow(rows, RECORD)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages as archives in the shared folder, read them back."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, **options)
    return read(pages.sparkSession, path).filter("NOT gap")


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS first FROM p),
s AS (SELECT page_id, first, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS x FROM f),
n AS (SELECT *, list_transform(range(0, 32), lambda i: list_sum(list_transform(range(0, 5), lambda k:
  CASE WHEN substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', substr(x, (5 * i + k) // 4 + 1, 1)) - 1)::INT + ((5 * i + k) % 4)::INT + 1, 1) = '1' THEN 1 << (4 - k)::INT ELSE 0 END))) AS v FROM s)
SELECT page_id, payload_bytes, list_aggregate(list_transform(v, lambda c: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', c::INT + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM n
"""
