import base64
import hashlib

import duckdb

from tierlake.llm import warc
from tierlake.llm.common import shared_path


def expected(rows, least=0):
    holder = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= least:
            holder[html or ""] = max(page, holder.get(html or "", page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        to = holder.get(html or "")
        revisit = to is not None and to != page
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a/", "<p>é😀</p>"), (2, None, None), (3, "u\r\nv", ""), (4, "http://b/", "x" * 300_000), (5, "http://b/", "x" * 300_000), (5, "http://c/", "x" * 300_000), (None, "http://d/", "<p>é😀</p>"), (None, "e", "alone"), (7, "f", "short"), (8, "f", "short\r\n\r\nWARC/1.1")]


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "page_id long, url string, html string, file string, offset int")
    for least in (0, 6):
        folder = shared_path(spark, "t")
        index = warc.write(pages, folder, min_bytes=least)
        back = warc.read(index, folder, keep_payload=True)
        assert got(back) == expected(ROWS, least)
        for r in back.collect():
            assert (r.payload is None) == (r.record_type == "revisit")
        some = warc.read(index.where("page_id in (1, 8)"), folder, gap=0, most=10, keep_payload=True).collect()
        assert {bytes(r.payload) for r in some if r.payload is not None} <= {h.encode() for _, _, h in ROWS if h}


def test_empty(spark):
    folder = shared_path(spark, "t")
    assert warc.read(warc.write(spark.createDataFrame([], "page_id long, url string, html string"), folder), folder).count() == 0


def test_query(spark, sf):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    found = got(warc.op8_warc(spark, sf))
    assert found == expected(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert sorted(con.execute(warc.ORACLE_SQL["op8_warc"]).fetchall(), key=str) == found


def test_reads_go_by_bytes(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "".join(chr(33 + (i * 7 + j * j) % 90) for j in range(3000))) for i in range(200)], "page_id long, url string, html string")
    folder = shared_path(spark, "t")
    index = warc.write(pages, folder)
    total = sum(r.length for r in index.collect())
    back = warc.read(index, folder, per_task=total // 8)
    assert 8 <= back.rdd.getNumPartitions() <= 9 and back.count() == 200
    few = warc.read(index, folder, per_task=total // 100, most_tasks=5)
    assert few.rdd.getNumPartitions() <= 5 and got(few) == got(back)
