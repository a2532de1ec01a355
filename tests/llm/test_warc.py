import gzip
import random

import pytest

from quillon.llm import warc
from quillon.llm.common import scratch_path


def put(tmp_path, name, data):
    (tmp_path / name).write_bytes(data)
    return f"file://{tmp_path}/{name}", len(data)


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, length long")


def sequential(data):
    at, out = 0, []
    while at < len(data) and (found := warc.header(data[at : at + 70_000])):
        body, n = at + found[0], int(found[1]["content-length"])
        if body + n + 4 > len(data):
            break
        out.append((at, found[1].get("warc-target-uri"), data[body : body + n]))
        at = body + n + 4
    return out


@pytest.mark.parametrize("split", [1, 7, 64, 500, 4096, 1 << 20])
def test_magic_in_payloads_is_rejected(spark, tmp_path, split):
    rng = random.Random(split)
    data = b""
    for k in range(40):
        payload = rng.choice([b"", b"plain", warc.decoy(k), warc.record("response", "http://fake", b"x" * rng.randrange(90), "fake", "t") * 3, b"WARC/1.1\r\nContent-Length: 99999999\r\n\r\n", bytes(rng.randrange(256) for _ in range(rng.randrange(400)))])
        data += warc.record("response", f"http://true/{k}", payload, f"true:{k}", "text/html")
    if split == 1:
        data = data[: sequential(data)[4][0]]
    path, size = put(tmp_path, "a.warc", data)
    got = sorted((r.offset, r.target_uri, bytes(r.payload)) for r in warc.records(spark, files(spark, (path, size)), warc.Params(split_bytes=split, tasks=8)).collect())
    want = sequential(data)
    assert got == want and len(want) == (4 if split == 1 else 40) and all(u.startswith("http://true/") for _, u, _ in want)


def test_broken_files(spark, tmp_path):
    one = warc.record("response", "http://a", b"first", "1", "t")
    rows = [put(tmp_path, "b.warc", one + b"garbage" + one), put(tmp_path, "c.warc", b"no record\r\n" + one), put(tmp_path, "d.warc", one + one[:-9]), put(tmp_path, "e.warc", b""), put(tmp_path, "f.warc", one * 3)]
    got = warc.records(spark, files(spark, *rows, rows[4], (None, 5), (rows[4][0], None)), warc.Params(split_bytes=100, tasks=4)).collect()
    assert sorted((r.file[-6:], r.offset) for r in got) == [("b.warc", 0), ("d.warc", 0), ("f.warc", 0), ("f.warc", len(one)), ("f.warc", 2 * len(one))]


def test_pages_come_back_whole(spark):
    df = spark.createDataFrame(
        [(1, "http://x/1", "<p>" + warc.decoy(1).decode() + "</p>", 0), (1, "http://x/1", "<p>twice</p>", 0), (2, None, None, 0), (3, "http://x/ü\nz", "é" * 200_000, 0), (None, "u", "h", 0), (-4, "", "", 0)], "page_id long, url string, html string, length int"
    )
    got = sorted((r.page_id, r.url, r.html, r.length) for r in warc.pages_through_warc(spark, df, warc.Params(split_bytes=1000, tasks=4)).collect() if r.page_id != 2)
    assert got == sorted([(1, "http://x/1", "<p>" + warc.decoy(1).decode() + "</p>", len("<p></p>") + len(warc.decoy(1))), (1, "http://x/1", "<p>twice</p>", 12), (3, "http://x/ü z", "é" * 200_000, 400_000), (-4, "", "", 0)])
    empty = warc.pages_through_warc(spark, df.where("page_id = 2")).first()
    assert (empty.url, empty.html, empty.length) == (None, "", 0)
    assert warc.pages_through_warc(spark, df.limit(0)).count() == 0


@pytest.mark.parametrize("split", [1000, 1 << 20])
def test_headers_of_any_length(spark, split):
    long = "data:text/html," + "x" * 200_000
    df = spark.createDataFrame([(1, "http://x/1", "one"), (2, long, "two"), (3, "http://x/3", "WARC/1.1\r\nA: " + "y" * 150_000), (4, "http://x/4", "four")], "page_id long, url string, html string").coalesce(1)
    got = sorted((r.page_id, r.url, r.html) for r in warc.pages_through_warc(spark, df, warc.Params(split_bytes=split, tasks=8)).collect())
    assert got == sorted((r.page_id, r.url, r.html) for r in df.collect())


def test_scratch_is_in_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


@pytest.mark.parametrize("split", [97, 1500, 1 << 20])
def test_gzip_members(spark, tmp_path, split):
    """Stored blocks leave payloads as they are, so that whole members quoted in them are candidates too."""
    rng, raw, want = random.Random(split), b"", []
    for k in range(25):
        inner = gzip.compress(warc.record("response", "http://fake", b"y" * rng.randrange(50), "fake", "t"), mtime=0)
        payload = rng.choice([b"", b"plain", inner * 2, b"\x1f\x8b\x08" * 9, bytes(rng.randrange(256) for _ in range(rng.randrange(900))), b"z" * 100_000])
        record = warc.record("response", f"http://true/{k}", payload, f"true:{k}", "t")
        want.append((len(raw), f"http://true/{k}", payload))
        raw += gzip.compress(record, compresslevel=rng.choice([0, 6]), mtime=0)
    many = b"".join(warc.record("response", f"http://one/{k}", b"p" * (k * 30_000), f"{k}", "t") for k in range(6))
    rows = [put(tmp_path, "a.warc.gz", raw), put(tmp_path, "b.warc.gz", gzip.compress(many, mtime=0)), put(tmp_path, "c.warc.gz", raw[: want[3][0] + 9])]
    if split == 97:
        rows = rows[2:]
    got = warc.records(spark, files(spark, *rows), warc.Params(split_bytes=split, tasks=8)).collect()
    by = lambda name: sorted((r.offset, r.target_uri, bytes(r.payload)) for r in got if r.file.endswith(name))
    if split != 97:
        assert by("a.warc.gz") == want
        assert by("b.warc.gz") == [(0, f"http://one/{k}", b"p" * (k * 30_000)) for k in range(6)]
    assert by("c.warc.gz") == want[:3]
