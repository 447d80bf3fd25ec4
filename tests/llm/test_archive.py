"""ARC parsing, WARC synthesis and the round trip."""

import base64
import gzip
import hashlib
import io

import pytest

from preflens.frames import ship
from preflens.llm import archive


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    data = archive.arc_version_block("x.arc", version)
    blocks = [b"HTTP/1.1 200 OK\r\n\r\n<p>\n\n1 2 3 4 5\n</p>", b"", b"plain\n"]
    for i, block in enumerate(blocks):
        data += archive.arc_record(version, f"http://a.example/{i} b", "20080430204825", "text/html", block)
    got = list(archive.read_arc(io.BytesIO(data)))
    assert [b for _, _, b in got] == blocks
    assert [f["URL"] for _, f, _ in got] == [f"http://a.example/{i}%20b" for i in range(3)]
    assert all(data[o:].startswith(f["URL"].encode()) for o, f, _ in got)
    assert {f["Archive-length"] for _, f, _ in got} == {str(len(b)) for b in blocks}
    with pytest.raises(ValueError):
        list(archive.read_arc(io.BytesIO(data[:-5])))


def test_short_line_in_a_version_2_file():
    data = archive.arc_version_block("x.arc", 2) + archive.arc_record(1, "http://a/", "199612", "text/html", b"abc")
    (_, fields, block), = archive.read_arc(io.BytesIO(data))
    assert block == b"abc" and fields["Content-type"] == "text/html"
    assert archive.warc_date(fields["Archive-date"]) == "1996-12-01T00:00:00Z"


def test_round_trip(spark, frame, tmp_path):
    ship(spark)
    rows = [(i, f"http://h{i % 3}.example/ä?q={i}", f"<p>{i % 7} é</p>") for i in range(40)]
    rows += [(50, None, None), (51, "no scheme", ""), (None, "http://n/", "<p>1 é</p>"), (None, "http://n/", "own"), (None, "http://n/", "own"), (3, "http://h0.example/ä?q=3", "<p>3 é</p>"), (60, "u", "x" * 300_000)]
    df = frame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, file string, offset int", 3)
    got = archive.archive(df, folder=f"file://{tmp_path}/out").collect()
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    want, first = [], {}
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        payload = (html or "").encode()
        kind = "revisit" if payload in first else "response"
        want.append((i, len(payload), sha(payload), kind, first.get(payload)))
        first.setdefault(payload, i)
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    files = sorted((tmp_path / "out/warc").glob("[!.]*.warc.gz"))
    kinds = [f["warc-type"] for p in files for f, _ in archive.read_warc(io.BytesIO(gzip.decompress(p.read_bytes())))]
    assert kinds.count("warcinfo") == len(files) and len(kinds) == len(rows) + len(files)
    assert len({r["record_id"] for r in got}) == len(rows)


def test_least_bytes_and_empty(spark, frame):
    ship(spark)
    df = frame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    assert {r["page_id"]: r["refers_to"] for r in archive.archive(df, least_bytes=3).collect()} == {1: None, 2: None, 3: None, 4: 3}
    assert archive.archive(df.limit(0)).collect() == []
