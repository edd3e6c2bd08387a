import gzip
import hashlib
import io
import random

import pytest

from panelwise.llm import warc

ROWS = [(1, "a" * 1500), (2, "a" * 1500), (3, "b" * 999), (4, "b" * 999), (5, None), (6, ""), (7, "é" * 500), (9, "é" * 500), (9, "é" * 500), (None, "a" * 1500), (11, "x<p>" * 300000), (12, "\r\n\r\nWARC/1.1\r\n\r\n"), (13, "q" * 1000)]


def brute(rows):
    largest = {}
    for i, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            largest[h] = max(largest.get(h, i), i)
    out = []
    for i, h in rows:
        p = (h or "").encode()
        top = largest.get(h) if len(p) >= 1000 else None
        again = top is not None and i != top
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split", [warc.SPLIT_BYTES, 300])
def test_round_trip(spark, split):
    pages = spark.createDataFrame([(i, f"http://h/{i}\nx", h, 4) for i, h in ROWS], "page_id bigint, url string, html string, payload int").repartition(3)
    files = warc.write(pages)
    got = warc.read(files, split).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(ROWS)
    whole = {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response"}
    assert all(whole[i] == (h or "") for i, h in ROWS if i in whole)


def test_archives_are_plain_gzip_and_every_split_finds_each_record_once():
    rng = random.Random(0)
    records = [warc.record(i, "u", rng.randbytes(rng.randrange(3000)), "00" * 20, None, "d") for i in range(40)]
    data = b"".join(map(warc.member, records))
    assert gzip.decompress(data) == b"".join(records)
    for size in (1, 97, 1000, len(data)):
        found = [d for a in range(0, len(data), size) for _, d in warc.starts(io.BytesIO(data), a, min(a + size, len(data)))]
        assert found == records


def test_false_magic_and_damage_are_skipped():
    good = warc.member(warc.record(1, "u", b"x", "00" * 20, None, "d"))
    other = warc.member(b"no archive")
    data = warc.MAGIC + b"junk" + other + good + warc.MAGIC + good[:30]
    assert [warc.parsed(d)["page_id"] for _, d in warc.starts(io.BytesIO(data), 0, len(data))] == [1]


def test_empty_table(spark):
    files = warc.write(spark.createDataFrame([], "page_id bigint, url string, html string"))
    assert warc.read(files).count() == 0


def test_ranges_are_read_in_as_many_tasks(spark):
    pages = spark.range(200).selectExpr("id AS page_id", "'u' AS url", "repeat(concat('page ', id), 50) AS html").repartition(2)
    files = warc.write(pages)
    sizes = [r.bytes for r in files.collect()]
    split = -(-sum(sizes) // 12)
    ranges = sum(-(-n // split) for n in sizes)
    got = warc.read(files, split)
    assert got.count() == 200 and got.rdd.getNumPartitions() == ranges
