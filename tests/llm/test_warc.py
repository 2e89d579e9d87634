import base64
import gzip
import hashlib

import pytest

from convsift.llm import warc

PAGES = "page_id bigint, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def run(spark, tmp_path, rows, extra=None):
    df = pages(spark, rows)
    if extra:
        df = extra(df)
    df.write.parquet(str(tmp_path / "pages.parquet"))
    out = warc.query(spark, str(tmp_path)).collect()
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str)


def want(rows):
    first = {}
    for p, _, h in rows:
        first.setdefault(h or "", []).append(p)
    out = []
    for p, _, h in rows:
        data = (h or "").encode()
        ids = [x for x in first[h or ""] if x is not None]
        least = min(ids) if ids else None
        same = p == least
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "response" if same else "revisit", None if same else least))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path, clashing):
    rows = [(1, "http://a.example/x?y=1", "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n</p>"), (2, None, None), (3, "x y\nz", ""),
            (4, "https://b.example/", "<p>same</p>"), (9, "http://c.example/", "<p>same</p>"), (0, "http://d.example/", "<p>same</p>"),
            (None, "http://e.example/", "<p>same</p>"), (11, "", "z" * 3_000_000), (12, "http://f.example", "\n"), (13, "u", "\x1f\x8b")]
    assert run(spark, tmp_path, rows, clashing) == want(rows)


def test_repeated_rows_are_all_responses(spark, tmp_path):
    rows = [(5, "http://a.example/", "<b>t</b>")] * 2 + [(6, "http://a.example/", "<b>t</b>")]
    assert [(r[0], r[3], r[4]) for r in run(spark, tmp_path, rows)] == [
        (5, "response", None), (5, "response", None), (6, "revisit", 5)]


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_many_equal_payloads(spark, tmp_path):
    rows = [(i, f"http://h{i}.example/", "same" if i % 3 else f"own {i}") for i in range(3, 600)]
    assert run(spark, tmp_path, rows) == want(rows)


def test_small_payloads_may_all_stay(spark):
    rows = pages(spark, [(1, "http://a", "xy"), (2, "http://b", "xy"), (3, "http://c", "long" * 9), (4, "http://d", "long" * 9)])
    out = warc.mark_revisits(warc.to_warc_rows(warc.pages_to_arc(rows)), min_bytes=10).where("page_id IS NOT NULL").collect()
    assert {(r.page_id, r.record_type) for r in out} == {(1, "response"), (2, "response"), (3, "response"), (4, "revisit")}


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    records = [("http://a.example/p q", "1.2.3.4", "20010203040506", "text/html", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\nhttp://x 1 2 3 4\n"),
               ("dns:a.example", "1.2.3.4", "200102030405", "text/dns", b"20010203\na. 1 IN A 1.2.3.4\n"), ("ftp://f", "-", "bad", "x", b"")]
    data = warc.write_arc(records[:2], "t.arc", version)
    back = list(warc.read_arc(data))
    assert [r[4] for r in back[1:]] == [r[4] for r in records[:2]] and back[1][0] == records[0][0]
    assert back[0][0] == "filedesc://t.arc" and back[0][4].startswith(str(version).encode())
    rows = [warc.convert_record(*r) for r in back]
    assert [r[1] for r in rows] == ["warcinfo", "response", "resource"]
    assert rows[1][4] == "2001-02-03T04:05:06Z" and rows[2][4] == "2001-02-03T04:05:00Z"
    assert rows[1][8] == b"body\nhttp://x 1 2 3 4\n" and rows[1][7].endswith(b"\r\n\r\n")
    assert [warc.convert_record(*r)[0] for r in back] == [r[0] for r in rows] and len({r[0] for r in rows}) == 3


def test_broken_arc_headers_and_cut_records():
    good = ("http://a.example/", "1.1.1.1", "20010203040506", "text/html", b"HTTP/1.0 200 OK\r\n\r\nx")
    data = warc.write_arc([good], "t.arc", 1)
    bent = data + b"no header at all\n" + data[data.index(b"http://a.example/"):]
    assert [r[4] for r in warc.read_arc(bent)][1:] == [good[4], good[4]]
    cut = list(warc.read_arc(data[:-3]))
    assert cut[-1][5] and cut[-1][4] == good[4][:-2]
    assert list(warc.read_arc(b"")) == []


def test_read_archives_of_many_members():
    record = warc.warc_record("urn:uuid:1", "response", "http://a", "0.0.0.0", "2024-01-01T00:00:00Z", "application/http;msgtype=response",
                              b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\n", b"ok", warc.sha1(b"ok"),
                              warc.sha1(b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nok"), False, None)
    for data in (record * 3, gzip.compress(record) * 3, gzip.compress(record * 3)):
        back = list(warc.parse_warc(data))
        assert len(back) == 3 and all(r[-1] and r[8] == b"ok" for r in back)
    assert not list(warc.parse_warc(record.replace(b"\r\n\r\nok", b"\r\n\r\nno")))[0][-1]
