import gzip
import io
import random

import pytest

from corpusmill.llm.warc import audit, damaged, digest, leaves, parents, read_records, read_warc, records, write_records, write_warc

PAGES = "page_id long, url string, html string, offset int"


def pages(n, seed=0):
    rng = random.Random(seed)
    return [(i, f"http://x.org/{i}", "<p>" + "é " * rng.randrange(50), 1) for i in range(n)]


def test_record_table_follows_the_bytes_of_the_file(spark):
    rows = pages(30)
    out = io.BytesIO()
    places = write_warc(out, ((u, h.encode()) for _, u, h, _ in rows))
    got = sorted(records(spark.createDataFrame(rows, PAGES)).collect(), key=lambda r: r.number)
    assert [(r.offset, r.length) for r in got] == places
    data = out.getvalue()
    assert [r.digest for r in got] == [digest(data[a : a + n]) for a, n in places]


@pytest.mark.parametrize("gzipped", [False, True])
def test_files_round_trip(gzipped):
    items = [("http://a", b"x" * 200_000), ("http://b", b""), ("http://c", "é\r\n\r\nWARC/1.1".encode())]
    out = io.BytesIO()
    places = write_warc(out, iter(items), gzipped)
    out.seek(0)
    assert [(h["warc-target-uri"], b) for h, b in read_warc(out)] == items
    a, n = places[1]
    one = out.getvalue()[a : a + n]
    assert list(read_warc(io.BytesIO(one)))[0][1] == b""
    assert list(read_warc(io.BytesIO(b""))) == []
    plain = gzip.decompress(out.getvalue()) if gzipped else out.getvalue()
    with pytest.raises(ValueError):
        list(read_warc(io.BytesIO(plain[:-30])))
    with pytest.raises(ValueError):
        list(read_warc(io.BytesIO(b"junk\r\n")))


@pytest.mark.parametrize("fanout, levels, per_archive", [(16, 3, 1024), (2, 3, 40), (3, 1, 1000)])
def test_audit_finds_what_comparing_all_records_finds(spark, fanout, levels, per_archive):
    rng = random.Random(fanout)
    left = records(spark.createDataFrame(pages(150), PAGES), per_archive).select("archive", "number", "offset", "length", "digest").collect()
    right = []
    for r in left:
        k = rng.random()
        if k < 0.03:
            continue
        right.append((r.archive, r.number, r.offset + (k > 0.97), r.length, digest(b"?") if 0.03 <= k < 0.06 else r.digest))
    right.append((99, 0, 0, 5, digest(b"new")))
    schema = "archive long, number long, offset long, length long, digest string"
    got = audit(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), fanout, levels).collect()
    a, b = {tuple(r)[:2]: tuple(r)[2:] for r in left}, {r[:2]: r[2:] for r in right}
    want = set()
    for k in a.keys() | b.keys():
        x, y = a.get(k), b.get(k)
        if x != y:
            want.add((k, "missing_left" if x is None else "missing_right" if y is None else "moved" if x[2] == y[2] else "corrupt"))
    assert {((r.archive, r.number), r.fault) for r in got} == want and len(got) == len(want) > 5


def test_equal_replicas_have_equal_roots_and_no_faults(spark):
    table = records(spark.createDataFrame(pages(60), PAGES))
    assert audit(table, records(spark.createDataFrame(pages(60)[::-1], PAGES).repartition(3))).collect() == []
    one, two = (parents(leaves(t), 1, levels=1).collect() for t in (table, table.where("number <> 7")))
    assert one[0]["hash"] != two[0]["hash"] and (one[0]["first"], one[0]["last"]) == (two[0]["first"], two[0]["last"])


def test_nulls_repeats_clashes_long_and_empty_tables(spark):
    rows = [(1, None, None, 0), (1, None, None, 0), (None, "u", "x", 0), (None, "v", "y" * 300_000, 0), (2, "u", "", 0), (2, "u", "z", 0)]
    table = spark.createDataFrame(rows, PAGES)
    got = records(table).collect()
    assert sorted((r.page_id or -1, r.copies) for r in got) == [(-1, 1), (-1, 1), (1, 2), (2, 1), (2, 1)]
    assert sorted(r.number for r in got if r.archive == 0) == [0, 1, 2]
    empty = records(table.limit(0))
    assert audit(empty, empty).collect() == []
    assert {r.fault for r in audit(records(table), empty).collect()} == {"missing_right"}


def test_planted_damage_is_located(spark):
    rows = pages(3000)
    table = spark.createDataFrame(rows, PAGES)
    got = audit(records(table), damaged(table)).collect()
    import hashlib

    marks = {i: hashlib.md5(str(i).encode()).hexdigest() for i in range(3000)}
    assert {r.archive * 1024 + r.number: r.fault for r in got} == {i: "missing_right" if m[2] >= "8" else "corrupt" for i, m in marks.items() if m < "04"}


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_files_come_back_record_by_record(spark, tmp_path, compression):
    rows = [(i, f"http://x.org/{i}", f"<p>é {i}</p>" * (i + 1)) for i in range(60)] + [(None, None, None), (61, "http://x.org/in", "<pre>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n</pre>"), (62, "http://x.org/e", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    write_records(pages.repartition(3), str(tmp_path / "w"), compression)
    got = read_records(spark, str(tmp_path / "w")).collect()
    assert sorted((r.url, bytes(r.body).decode()) for r in got) == sorted((u or "", h or "") for _, u, h in rows)
    assert all(r.whole and r.type == "response" and r.headers["content-length"] == str(len(r.body)) for r in got)


def test_files_by_record_gzip_and_broken_ones(spark, tmp_path):
    with open(tmp_path / "a.warc.gz", "wb") as f:
        write_warc(f, iter([("http://a", b"\xff\x00raw"), ("http://b", b"two")]), gzipped=True)
    (tmp_path / "b.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nshort")
    (tmp_path / "c.warc").write_bytes(b"")
    got = {(r.url, bytes(r.body), r.whole) for r in read_records(spark, f"{tmp_path}/*.war*").collect()}
    assert got == {("http://a", b"\xff\x00raw", True), ("http://b", b"two", True), (None, b"short", False)}


def test_lost_copies_of_a_record_are_a_fault(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "v", "b"), (2, "v", "b")], "page_id long, url string, html string")
    found = audit(records(pages), records(pages.dropDuplicates())).collect()
    assert [(r.number, r.fault) for r in found] == [(1, "copies_differ")]
    assert audit(records(pages), records(pages).drop("copies")).count() == 1


def test_binary_bodies_dates_and_identifiers(spark, tmp_path):
    rows = [("http://a", bytearray(range(256))), ("http://b", bytearray(b"\xff\xfe\n\r\n")), (None, None)]
    pages = spark.createDataFrame(rows, "url string, html binary").selectExpr("*", "1 as digest", "2 as type")
    write_records(pages, str(tmp_path / "w"), date="2024-05-06T07:08:09Z")
    got = {r.url: r for r in read_records(spark, str(tmp_path / "w")).collect()}
    assert {u: bytes(r.body) for u, r in got.items()} == {u or "": bytes(h or b"") for u, h in rows}
    assert all(r.whole and r.headers["warc-date"] == "2024-05-06T07:08:09Z" and r.headers["warc-record-id"].startswith("<urn:uuid:") for r in got.values())
    assert len({r.headers["warc-record-id"] for r in got.values()}) == 3
    write_records(pages.limit(0), str(tmp_path / "none"))
    assert read_records(spark, str(tmp_path / "none")).collect() == []
