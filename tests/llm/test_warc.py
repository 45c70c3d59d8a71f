import hashlib

import pytest

from lectern.llm.common import new_path
from lectern.llm.warc import END, MAGIC, archive_round_trip, read_warc, write_warc

SCHEMA = "page_id long, url string, html string, digest int, n int"


def expected(rows, least):
    out, top = [], {}
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        if page is not None and len(data) >= least:
            top[data] = max(top.get(data, page), page)
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        first = top.get(data)
        revisit = first is not None and (page is None or page < first)
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def fake(n):
    inner = f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:x:{n}>\r\nContent-Length: 3\r\n\r\nabc{END}"
    return f"<p>{n}</p>" + inner * 3 + MAGIC + "no header here " * 40 + MAGIC * 2


@pytest.fixture
def rows():
    shared = "same " * 400
    rows = [(i, f"http://h/{i}\r\nX: y", fake(i) * (1 + i % 5), 1, 2) for i in range(60)]
    rows += [(100 + i, None, shared, None, None) for i in range(30)]
    rows += [(200, "u", "short"), (201, "u", "short"), (202, "u", None), (203, "u", ""), (None, "u", shared), (None, None, "é" * 700)]
    rows += [(300, "u", shared + "x"), (300, "u", shared + "x"), (301, "u", MAGIC * 200), (302, "u", "WARC/1.1"), (303, "u", END * 9)]
    return [tuple(r) + (None,) * (5 - len(r)) for r in rows]


@pytest.mark.parametrize("block", ["128m", "3000", "700"])
def test_round_trip_keeps_every_payload(spark, rows, block):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        pages = spark.createDataFrame(rows, SCHEMA).coalesce(2)
        got = archive_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got), key=repr) == expected(rows, 1000)


def test_unreachable_records_are_not_read(spark, tmp_path):
    """A chain that breaks hides what follows it, however much that looks like records."""
    record = f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Page-ID: %d\r\nContent-Length: 5\r\n\r\nhello{END}"
    (tmp_path / "a.warc").write_bytes((record % 1 + record % 2 + "junk" + record % 3).encode())
    (tmp_path / "b.warc").write_bytes(("junk" + record % 4).encode())
    (tmp_path / "c.warc").write_bytes((record % 5).encode())
    got = read_warc(spark, f"file://{tmp_path}").collect()
    assert sorted(r["page_id"] for r in got) == [1, 5]
    assert {(r["offset"], r["payload_bytes"]) for r in got} == {(0, 5)}


def test_empty_table(spark):
    assert archive_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_archives_are_plain_files(spark, rows):
    path = new_path(spark, "plain")
    write_warc(spark.createDataFrame(rows[:3], SCHEMA).coalesce(1), path)
    data = b"".join(r["content"] for r in spark.read.format("binaryFile").load(path + "/*.txt").collect())
    assert data.startswith(MAGIC.encode()) and data.endswith(END.encode())
