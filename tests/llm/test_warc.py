import gzip
import hashlib
from collections import Counter

import pytest

from tabulon.llm import warc
from tabulon.llm.common import new_path


def frame(spark, rows):
    return spark.createDataFrame([(p, u, h, "x", 1) for p, u, h in rows], "page_id long, url string, html string, payload string, key int")


def want(rows, least=1000):
    best = {}
    for p, _, h in rows:
        if p is not None:
            best[h or ""] = max(best.get(h or "", p), p)
    out = Counter()
    for p, _, h in rows:
        body = (h or "").encode()
        top = best.get(h or "")
        revisit = len(body) >= least and top is not None and p != top
        out[p, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", top if revisit else None] += 1
    return out


def round_trip(spark, rows, **kw):
    path = new_path(spark, "warc")
    warc.write_archives(frame(spark, rows), path, **kw)
    return Counter(tuple(r) for r in warc.resolve(warc.read_archives(spark, path)).collect())


LONG = "ä" * 600
ROWS = [
    (1, "http://a/x", LONG), (2, "http://b", LONG), (7, None, LONG), (3, "http://c d\n", "short"), (4, "u", "short"), (5, "u", None),
    (6, "u", ""), (8, "u", "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc" * 40), (9, "u", "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc" * 40),
    (10, "u", "y" * 1000), (11, "u", "y" * 999), (12, "u", "y" * 999), (13, "u", "line\n\r\r\n" * 200), (None, "u", LONG), (None, "u", "z" * 2000), (10, "u", "y" * 1000),
]


@pytest.mark.parametrize("size", [warc.ARCHIVE_BYTES, 1500])
def test_round_trip(spark, size):
    assert round_trip(spark, ROWS, archive_bytes=size) == want(ROWS)


def test_hot_payload_and_empty(spark):
    rows = [(i, "u", "h" * 3000) for i in range(200)] + [(500, "u", "tiny")]
    assert round_trip(spark, rows) == want(rows)
    assert round_trip(spark, []) == Counter()


def test_archives_hold_each_payload_once(spark):
    path = new_path(spark, "warc")
    warc.write_archives(frame(spark, ROWS), path)
    records = warc.read_archives(spark, path).collect()
    assert sum(r["payload"] is not None and bytes(r["payload"]) == LONG.encode() for r in records) == 1
    assert all(r["url"].isprintable() for r in records)


def test_record_ids_are_unique(spark):
    path = new_path(spark, "warc")
    warc.write_archives(frame(spark, [*ROWS, (None, "u", "q"), (4, "u", "short")]), path)
    ids = [r["record_id"] for r in warc.read_archives(spark, path).collect()]
    assert len(ids) == len(ROWS) + 2 == len(set(ids))


def foreign_record(i, body, kind="response"):
    http = b"HTTP/1.1 200 OK\r\nContent-Type:text/html\r\n\r\n" + body
    return (
        b"WARC/1.0\r\nwarc-type:%s\r\nWARC-RECORD-ID:   <urn:uuid:%d>\r\nWARC-Target-URI: http://h/\r\n  p%d\r\n"
        b"content-type: application/http; msgtype=response\r\nCONTENT-LENGTH:%d\r\n\r\n%s\r\n\r\n"
    ) % (kind.encode(), i, i, len(http), http)


@pytest.mark.parametrize("form", ["a member a record", "one member", "plain", "padded"])
def test_foreign_archives(spark, tmp_path, form):
    bodies = [b"", b"x" * 10, b"WARC/1.0\r\n\r\n" * 3, bytes(range(256)) * 1000]
    records = [foreign_record(i, b) for i, b in enumerate(bodies * 8)]
    data = {
        "a member a record": b"".join(map(gzip.compress, records)),
        "one member": gzip.compress(b"".join(records)),
        "plain": b"".join(records),
        "padded": b"".join(gzip.compress(r) + bytes(7) for r in records),
    }[form]
    (tmp_path / ("a.warc" if form == "plain" else "a.warc.gz")).write_bytes(data)
    found = {r["record_id"]: r for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert {k: bytes(r["payload"]) for k, r in found.items()} == {f"<urn:uuid:{i}>": b for i, b in enumerate(bodies * 8)}
    assert found["<urn:uuid:3>"]["url"] == "http://h/ p3" and found["<urn:uuid:3>"]["page_id"] is None


def test_cut_archives_are_told(spark):
    with pytest.raises(ValueError, match="within a gzip member"):
        list(warc.parse_records(warc.inflate(gzip.compress(foreign_record(1, b"a" * 1000))[:-9])))


def test_parser_in_steps():
    data = b"".join(foreign_record(i, b"y" * i) for i in range(30))
    whole = list(warc.parse_records(data))
    assert len(whole) == 30 and list(warc.parse_records(data[i : i + 7] for i in range(0, len(data), 7))) == whole


def test_parser():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\na\r\nb\r\n\r\n"
    assert [b for _, b in warc.parse_records(record * 2)] == [b"a\r\nb"] * 2
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.parse_records(b"HTTP/1.1\r\n\r\n"))
    with pytest.raises(ValueError, match="doesn't end"):
        list(warc.parse_records(record[:-2] + b"xx"))
