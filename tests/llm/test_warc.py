import gzip
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ragloom.llm import warc
from ragloom.llm.warc import END, WarcParams, base32_sha1, gaps, read_archives, record, records, salvage, write_archives


def made(n, zipped=False):
    out = []
    for i in range(n):
        p = f"<p>{i} WARC/1.1\r\nnot a record</p>".encode() * (i + 1)
        r = record(i, f"http://x/{i}", p, base32_sha1(p), None, False, "2024-01-01T00:00:00Z") + END
        out.append(gzip.compress(r, mtime=0) if zipped else r)
    return out


@pytest.mark.parametrize("zipped", [False, True])
def test_intact(zipped):
    parts = made(4, zipped)
    got = list(salvage(b"".join(parts)))
    assert [g[0] for g in got] == ["record"] * 4
    assert [g[1] for g in got] == [sum(map(len, parts[:i])) for i in range(4)]


@settings(max_examples=150, deadline=None)
@given(st.booleans(), st.integers(0, 10_000), st.sampled_from(["flip", "cut", "junk"]))
def test_one_damage_loses_one_record_at_most(zipped, where, how):
    parts = made(5, zipped)
    data = b"".join(parts)
    where %= len(data)
    if how == "flip":
        bad = data[:where] + bytes([data[where] ^ 0x55]) + data[where + 1 :]
    elif how == "cut":
        bad = data[:where] + data[where + 7 :]
    else:
        bad = data[:where] + b"\x00junk WARC/1.1\r\n junk\x1f\x8b\x08" + data[where:]
    got = list(salvage(bad))
    kept = [g for g in got if g[0] == "record"]
    names = {g[4].get("warc-record-id") for g in kept}
    assert len([i for i in range(5) if f"<{warc.NAME}{i}>" in names]) >= (3 if how == "cut" else 4)
    covered = sorted({(g[1], g[2]) for g in got})
    assert covered[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(covered, covered[1:])) and sum(covered[-1]) == len(bad)


def test_digest_check_quarantines():
    parts = made(3)
    bad = parts[1].replace(b"not a record", b"not a rec0rd", 1)
    got = list(salvage(parts[0] + bad + parts[2]))
    assert [(g[0], g[3]) for g in got][:2] == [("record", ""), ("gap", "block digest differs")]
    assert got[-1][0] == "record" and got[-1][4]["warc-record-id"] == f"<{warc.NAME}2>"


@pytest.mark.parametrize("zipped", [False, True])
def test_round_trip(spark, tmp_path, zipped):
    rows = [(1, "http://a/\r\nX: y", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (None, "u", "same"), (None, "u", "alone"),
            (5, "u", "long é" * 50_000), (6, "u", "twice"), (6, "u", "twice")]
    pages = spark.createDataFrame([(a, b, c, 0) for a, b, c in rows], "page_id long, url string, html string, digest int")
    path = str(tmp_path / "w")
    write_archives(pages.repartition(3), path, WarcParams(block_bytes=300, gzip=zipped))
    found = read_archives(spark, path)
    assert gaps(found).count() == 0
    got = sorted((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in records(found).collect())
    assert got == sorted([
        (False, 1, "revisit", 2, 4), (False, 2, "response", None, 4), (False, 3, "revisit", 4, 0), (False, 4, "response", None, 0),
        (True, 0, "revisit", 2, 4), (True, 0, "response", None, 5), (False, 5, "response", None, 350_000),
        (False, 6, "response", None, 5), (False, 6, "response", None, 5)])
    file = max((os.path.join(path, f) for f in os.listdir(path) if f.startswith("part")), key=os.path.getsize)
    with open(file, "r+b") as f:
        f.seek(os.path.getsize(file) // 2)
        f.write(b"\xff\xff")
    os.remove(os.path.join(path, f".{os.path.basename(file)}.crc"))
    broken = read_archives(spark, path)
    assert gaps(broken).count() >= 1 and records(broken).count() == len(rows) - 1


def test_no_pages(spark, tmp_path):
    path = str(tmp_path / "w")
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert read_archives(spark, path).count() == 0
