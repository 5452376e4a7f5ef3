import base64
import hashlib

from lexarray.llm.warc import archived, read_warc, reachable, write_warc


def brute(rows, least=0):
    first = {}
    for d, h in rows:
        if d is not None and len((h or "").encode()) >= least:
            first[h or ""] = min(d, first.get(h or "", d))
    out = []
    for d, h in rows:
        b = (h or "").encode()
        f = first.get(h or "")
        again = f is not None and d != f
        out.append((d, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def got(df):
    rows = df.collect()
    assert all(r.valid for r in rows)
    return sorted((tuple(r)[:5] for r in rows), key=str)


def test_real_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert got(archived(pages)) == brute([(r.page_id, r.html) for r in pages.collect()])


FAKE = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def test_edge_cases(spark):
    rows = [(5, "u", "a"), (3, "u 1\r\nX: y", "a"), (9, None, "a"), (1, "u", None), (2, "u", ""), (4, "u", FAKE), (6, "u", FAKE * 3), (7, "é", "é😀\r\n\r\n"), (8, "u", "x" * 300000), (10, "u", "lone"), (10, "u", "lone"), (None, "u", "b"), (11, "u", "b"), (None, "u", "c")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    assert got(archived(df)) == brute([(r[0], r[2]) for r in rows])
    assert got(archived(df, least=2)) == brute([(r[0], r[2]) for r in rows], 2)
    assert archived(df.limit(0)).collect() == []


def test_round_trip_of_payloads(spark, tmp_path):
    rows = [(i, "u", f"page {i % 7} é {FAKE}") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    write_warc(df, str(tmp_path / "w"), records_per_file=8)
    back = {r.page_id: r for r in read_warc(spark, str(tmp_path / "w"), payloads=True).collect()}
    assert set(back) == set(range(30))
    for i, _, html in rows:
        r = back[i]
        origin = back[r.refers_to] if r.record_type == "revisit" else r
        assert bytes(origin.payload).decode() == html and (i < 7) == (r.record_type == "response")


def test_files_are_bounded_by_bytes(spark, tmp_path):
    sizes = [5, 100, 101, 900, 2500, 30, 99, 400, 2000, 0, 3, 101]
    rows = [(i, "u", chr(97 + i) * n) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    for limit in (1000, 10000, 1):
        where = tmp_path / str(limit)
        write_warc(df, str(where), records_per_file=10, file_bytes=limit)
        back = read_warc(spark, str(where), payloads=True).collect()
        assert sorted((r.page_id, bytes(r.payload).decode()) for r in back) == [(i, h) for i, _, h in rows]
        files = {}
        for r in back:
            files.setdefault(r.path, []).append(r.payload_bytes)
        assert all(len(f) <= 10 and (sum(f) <= limit or len(f) == 1 or sum(f) == 0) for f in files.values())


def test_one_huge_page_does_not_split_the_others(spark, tmp_path):
    rows = [(i, "u", chr(97 + i % 26) * (4000 + i)) for i in range(300)] + [(300, "u", "z" * 6_400_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    write_warc(df, str(tmp_path / "w"), file_bytes=12_800_000)
    back = read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted(r.page_id for r in back) == list(range(301)) and all(r.valid for r in back)
    assert len({r.path for r in back}) <= 2


def test_a_broken_chain_ends_there(spark):
    links = spark.createDataFrame([("f", 0, 10), ("f", 10, 25), ("f", 30, 40), ("g", 5, 9)], "path string, at long, next long")
    assert sorted(tuple(r) for r in reachable(links).collect()) == [("f", 0), ("f", 10)]
