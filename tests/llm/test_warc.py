import gzip
import zlib
from base64 import b32encode
from hashlib import sha1

from pyspark.sql import functions as F

from glyphmill.llm.warc import normalise_archives, read_records, record, split_records, write_archives


def test_members_stand_alone_at_their_offsets(spark):
    whole = [record(i, f"http://x/{i}", b"payload %d" % i, None, False) for i in range(20)]
    data = gzip.compress(b"".join(whole))
    rows = normalise_archives(spark.createDataFrame([(7, bytearray(data), "x")], "archive_id long, data binary, index string")).collect()
    (row,) = rows
    assert row["complete"] and len(row["index"]) == 20
    for entry, raw in zip(row["index"], whole):
        z = zlib.decompressobj(31)
        assert z.decompress(row["data"][entry["offset"] : entry["offset"] + entry["length"]]) == raw and z.eof and not z.unused_data
    assert gzip.decompress(bytes(row["data"])) == b"".join(whole)


def test_archives_of_several_members_and_broken_ones(spark):
    a, b = record(1, "u", b"one", None, False), record(2, None, b"two\r\n\r\nmore", None, False)
    assert list(split_records(gzip.compress(a) + gzip.compress(b))) == [a, b]
    assert list(split_records(gzip.compress(a + b[:40]))) == [a, None]
    assert list(split_records(gzip.compress(a + b"no record\r\n\r\n"))) == [a, None]
    assert list(split_records(b"")) == []
    broken = gzip.compress(a + b)[:-30]
    rows = normalise_archives(spark.createDataFrame([(1, bytearray(broken)), (2, None), (3, bytearray(b"junk"))], "archive_id long, data binary")).collect()
    by = {r["archive_id"]: r for r in rows}
    assert len(by[2]["index"]) == 0 and len(by[3]["index"]) == 0 and len(by[1]["index"]) <= 1


def test_payloads_come_back_whole(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    records = read_records(normalise_archives(write_archives(pages))).collect()
    want = {r["page_id"]: (r["html"] or "").encode() for r in pages.select("page_id", "html").collect()}
    assert len(records) == len(want) and all(r["intact"] for r in records)
    last = {}
    for i, p in want.items():
        last[p] = max(i, last.get(p, i))
    for r in records:
        p = want[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(p), b32encode(sha1(p).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if last[p] == r["page_id"] else ("revisit", last[p]))


def test_copies_refer_to_the_largest_id(spark):
    pages = spark.createDataFrame([(1, "u", "x", 0), (5, "v", "x", 0), (3, None, "x", 0), (4, "w", None, 0), (6, "w", "", 0), (None, "z", "x", 0)], "page_id long, url string, html string, sha long")
    rows = read_records(normalise_archives(write_archives(pages)))
    found = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in rows.collect()}
    assert found == {1: ("revisit", 5), 5: ("response", None), 3: ("revisit", 5), 4: ("revisit", 6), 6: ("response", None), None: ("revisit", 5)}
    assert write_archives(pages.filter(F.lit(False))).count() == 0


def test_common_payloads_are_not_met_by_key(spark):
    """Payloads of a third of all rows, and one of two rows, among many of one."""
    rows = [(i, f"u{i}", "" if i % 3 == 0 else "two" if i in (1, 5000) else f"<p>{i}</p>") for i in range(6000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in read_records(normalise_archives(write_archives(pages))).collect()}
    empty = max(i for i in range(6000) if i % 3 == 0)
    assert found[empty] == ("response", None) and found[0] == found[3] == ("revisit", empty)
    assert found[1] == ("revisit", 5000) and found[5000] == ("response", None) and found[7] == ("response", None)
    assert sum(kind == "revisit" for kind, _ in found.values()) == 2000
