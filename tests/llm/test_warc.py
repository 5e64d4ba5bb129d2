import gzip
import hashlib
import io
import os
import zlib

import pytest
from pyspark.sql import functions as F

from tidegrid.llm import warc

PAGES = "page_id long, url string, html string"


def rows():
    big = "<p>" + "ß" * 120 + "</p>"
    return [
        (5, "http://a", big),
        (3, "http://b\r\nX: y", big),
        (9, None, big),
        (9, None, big),
        (1, "u", "short"),
        (2, "u", "short"),
        (4, "", None),
        (6, "x", ""),
        (None, "n", big),
        (7, "w", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 9),
        (8, "l", "long " * 200_000),
        (10, "t", "a\nb\r\n\r\n"),
        *((i, "v", c * 200) for i, c in ((21, "A"), (22, "B"), (25, "A"), (25, "B"), (25, "C"))),
    ]


def expected():
    out, first = [], {}
    for page_id, _, html in rows():
        if page_id is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, page_id), page_id)
    for page_id, _, html in rows():
        body = (html or "").encode()
        origin = first.get(html) if page_id is not None else None
        revisit = origin is not None and page_id > origin
        out.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", origin if revisit else None))
    return out


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(rows(), PAGES).withColumn("digest", F.lit("own")).withColumn("value", F.lit(1)).repartition(3)
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = warc.op2_warc_round_trip(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected()))
    spark.createDataFrame([], PAGES).write.parquet(str(tmp_path / "none" / "pages.parquet"))
    assert warc.op2_warc_round_trip(spark, str(tmp_path / "none")).count() == 0


def test_archives_are_monolithic_then_by_member_with_an_index(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    warc.write_monolithic(spark.createDataFrame(rows(), PAGES).coalesce(1), raw, rows_per_file=5)
    found = warc.archives(spark, raw)
    n = warc.normalise(found, out).count()
    assert n == len(rows())
    index = warc.read_index(spark, out)
    assert index.count() == n
    names = {os.path.basename(r.archive) for r in index.collect()}
    for name in names:
        packed = open(f"{out}/{name}", "rb").read()
        parts = sorted((r.offset, r.length) for r in index.collect() if r.archive.endswith(name))
        assert parts[0][0] == 0 and sum(x for _, x in parts) == len(packed)
        assert all(a + x == b for (a, x), (b, _) in zip(parts, parts[1:], strict=False))
        single = b"".join(gzip.decompress(packed[a : a + x]) for a, x in parts)
        assert single == gzip.decompress(packed)
        origin = [p for p in os.listdir(raw) if p.split(".")[0] == name.split(".")[0] and p.endswith(".gz")]
        assert gzip.open(f"{raw}/{origin[0]}").read() == single
    payloads = {r.page_id: r.payload for r in warc.read_records(index).collect() if r.record_type == "response" and r.page_id is not None}
    wanted = {i: h or "" for i, _, h in rows() if i in payloads}
    assert {k: (v or b"").decode() for k, v in payloads.items()} == wanted
    assert not [p for p in os.listdir(out) if p.startswith(".part")]


def test_one_record_for_each_row_also_equals_the_sql(spark, tmp_path):
    import duckdb

    spark.createDataFrame(rows(), PAGES).filter("page_id is not null").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = warc.op2_warc_round_trip(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    wanted = con.execute(f"select {', '.join(got.columns)} from ({warc.OP2_SQL})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, wanted))


def record(n):
    body = b"x" * n
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: %d\r\n\r\n" % n + body + b"\r\n\r\n"


def read_all(packed):
    return [len(whole) for _, whole in warc.records_in(warc.Inflated(io.BytesIO(packed)))]


def test_cut_streams_are_refused():
    plain = record(10) + record(3000) + record(0)
    packed = gzip.compress(plain)
    assert read_all(packed) == [len(record(n)) for n in (10, 3000, 0)]
    assert read_all(gzip.compress(record(10)) + gzip.compress(record(3000))) == [len(record(10)), len(record(3000))]
    assert read_all(gzip.compress(b"")) == []
    for cut in range(len(packed)):
        with pytest.raises((ValueError, zlib.error)):
            read_all(packed[:cut])
    for cut in range(1, len(plain)):
        if cut not in (len(record(10)), len(record(10)) + len(record(3000))):
            with pytest.raises(ValueError):
                read_all(gzip.compress(plain[:cut]))
    broken = bytearray(packed)
    broken[-6] ^= 1
    with pytest.raises(zlib.error):
        read_all(bytes(broken))


def test_inflation_is_bounded():
    stream = warc.Inflated(io.BytesIO(gzip.compress(b"0" * 300_000_000)))
    assert stream.take(10) == b"0" * 10 and len(stream.out) <= warc._READ
