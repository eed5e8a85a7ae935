import random
import time
import zlib

from pyspark.sql import functions as F

from sheetwise.llm import warc


def test_salvage_recovers_after_damage():
    rng = random.Random(1)
    payloads = [bytes(rng.choices(b"<p>ab c</p>\n", k=rng.randrange(0, 900))) for _ in range(40)]
    for compress in (True, False):
        parts = [warc.record(i, f"http://x/{i}", p, warc.base32_sha1(p), None, compress) for i, p in enumerate(payloads)]
        raw = bytearray(b"".join(parts))
        starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
        for hit in (3, 17, 39):  # damage inside three records
            for k in range(5):
                raw[starts[hit] + len(parts[hit]) // 2 + k] ^= 0x55
        found = list(warc.salvage(bytes(raw), True))
        good = [r for r in found if not r["gap"]]
        assert [r["page_id"] for r in good] == [i for i in range(40) if i not in (3, 17, 39)]
        assert all(r["payload"] == payloads[r["page_id"]] for r in good)
        gaps = [(r["offset"], r["length"]) for r in found if r["gap"]]
        assert gaps == [(starts[i], len(parts[i])) for i in (3, 17, 39)]
        covered = sorted((r["offset"], r["length"]) for r in found)
        at = 0
        for offset, length in covered:  # every byte is a record's or a gap's
            assert offset == at
            at += length
        assert at == len(raw)
    assert list(warc.salvage(b"")) == []
    assert [r["gap"] for r in warc.salvage(b"junk")] == [True]


def test_urls_of_any_length():
    for compress in (True, False):
        urls = ["data:," + "x" * 100_000, "http://x/1", "data:," + " " * 100_000, None]
        raw = b"".join(warc.record(i, u, b"<p>", warc.base32_sha1(b"<p>"), 1 if i == 3 else None, compress) for i, u in enumerate(urls))
        assert [(r["gap"], r.get("page_id"), r.get("refers_to")) for r in warc.salvage(raw)] == [(False, 0, None), (False, 1, None), (False, 2, None), (False, 3, 1)]
        cut = raw if compress else raw.replace(warc.END, b"", 1)  # headers without an end: the next record is still found
        assert [r["page_id"] for r in warc.salvage(cut) if not r["gap"]] == ([0, 1, 2, 3] if compress else [1, 2, 3])


def member(plain):
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(plain) + z.flush()


def test_salvage_inside_a_member():
    rng = random.Random(2)
    payloads = [rng.randbytes(3000) for _ in range(9)]
    parts = [warc.record(i, f"http://x/{i}", p, warc.base32_sha1(p), None, False) for i, p in enumerate(payloads)]
    pages = lambda raw: [r["page_id"] for r in warc.salvage(raw) if not r["gap"]]
    gaps = lambda raw: [(r["offset"], r["length"]) for r in warc.salvage(raw) if r["gap"]]
    whole, other = member(b"".join(parts)), warc.record(77, "u", b"", warc.base32_sha1(b""), None)
    assert pages(whole) == list(range(9)) and gaps(whole) == []
    for hit in (0, 4, 8):  # a record damaged before it was packed
        bad = bytearray(parts[hit])
        bad[-100] ^= 1
        raw = member(b"".join([*parts[:hit], bytes(bad), *parts[hit + 1 :]]))
        assert pages(other + raw + other) == [77, *(i for i in range(9) if i != hit), 77] and gaps(other + raw + other) == [(len(other), len(raw))]
    cut = whole[: len(whole) * 2 // 3]
    assert pages(cut) == list(range(5)) or pages(cut) == list(range(6))
    assert gaps(cut) == [(0, len(cut))] and pages(cut + other)[-1] == 77 and pages(cut + other)[:5] == list(range(5))
    broken = bytearray(whole)
    broken[len(whole) // 2] ^= 0x55  # in stored bytes: only the checksum at the end fails
    assert pages(bytes(broken) + other) == [0, 1, 2, 3, 5, 6, 7, 8, 77] and gaps(bytes(broken) + other) == [(0, len(broken))]
    # Headers that no digest covers are not taken from a member that fails its checksum.
    z = zlib.compressobj(0, zlib.DEFLATED, 31)
    wrong = (z.compress(b"".join(parts)) + z.flush()).replace(b"X-Page-ID: 4", b"X-Page-ID: 5")
    assert pages(wrong) == [0, 1, 2, 3, 5, 6, 7, 8]


def test_salvage_reads_both_versions():
    parts = [warc.record(i, "u", b"<p>", warc.base32_sha1(b"<p>"), None, False).replace(b"WARC/1.1", b"WARC/1.0") for i in range(3)]
    for raw in (b"".join(parts), member(b"".join(parts)), b"".join(map(member, parts)), b"".join([parts[0], b"junk", parts[1], b"junk", parts[2]])):
        assert [r["page_id"] for r in warc.salvage(raw) if not r["gap"]] == [0, 1, 2]


def http_record(i, body, version=b"WARC/1.0"):
    """A record as crawlers write it: the block is an HTTP message, the payload digest that of its body."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    heads = [version, b"WARC-Type: response", b"WARC-Record-ID: <urn:x:%d>" % i, b"WARC-Target-URI: http://x/%d" % i, b"Content-Type: application/http; msgtype=response"]
    heads += [b"WARC-Payload-Digest: sha1:" + warc.base32_sha1(body).encode(), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(heads) + warc.END + block + warc.END


def test_records_of_crawlers():
    bodies = [b"<p>one</p>", b"", b"a\r\n\r\nb" * 50]
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\nx: y\r\n\r\n"
    plain = info + b"".join(http_record(i, b) for i, b in enumerate(bodies))
    for raw in (plain, member(plain), member(info) + b"".join(member(http_record(i, b, b"WARC/1.1")) for i, b in enumerate(bodies))):
        found = list(warc.salvage(raw, True))
        assert [(r["record_type"], r["payload"]) for r in found] == [("warcinfo", b"x: y"), *(("response", b) for b in bodies)] and not any(r["gap"] for r in found)
    bad = http_record(0, b"<p>one</p>").replace(b"<p>one", b"<p>two")
    assert [r["gap"] for r in warc.salvage(bad)] == [True]


def test_false_signatures_cost_time_in_proportion():
    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        found = list(warc.salvage(warc.GZIP * n + member(http_record(1, b"x"))))
        took.append(time.process_time() - began)
        assert [r["gap"] for r in found] == [True, False] and found[0]["length"] == 3 * n
    assert took[1] < 10 * took[0] + 1


def test_archives_are_bounded_by_bytes(spark, monkeypatch, tmp_path):
    rng = random.Random(3)
    rows = [(i, "u", "".join(rng.choices("abcdefghijklmnop", k=200_000))) for i in range(200)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
    sizes = [p.stat().st_size for p in (tmp_path / "w").glob("*.txt")]
    assert len(sizes) > 1 and max(sizes) <= warc.FILE_BYTES + len(warc.EMPTY_MEMBER) * 200
    assert warc.read(spark, str(tmp_path / "w")).filter("NOT gap").count() == 200


def test_round_trip_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "u", "a"), (2, None, "a"), (3, "u", None), (4, "u", ""), (5, "u x\r\n", "é\r\n\r\nWARC/1.1\r\n"), (6, "u", "a"), (6, "u", "b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit(1)).withColumn("payload", F.lit("x"))
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(pages).collect()}
    assert got == {(1, "response", None, 1), (2, "revisit", 1, 1), (3, "response", None, 0), (4, "revisit", 3, 0), (5, "response", None, 16), (6, "revisit", 1, 1), (6, "response", None, 1)}
    assert warc.round_trip(pages.limit(0)).count() == 0
    got = {(r.page_id, r.refers_to) for r in warc.round_trip(pages, min_bytes=1).collect()}
    assert (4, None) in got and (2, 1) in got
