"""Archives in pieces, without payloads, and what is said of broken ones."""

import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

from siftrank.sources import records as parsing
from siftrank.sources import warc
from siftrank.sources.warc import archive_files, archive_pieces, archive_report, read_warc


def record(name, body, kind="response", lead=b""):
    head = (
        f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-TREC-ID: {name}\r\nWARC-Target-URI: http://x.nl/{name}\r\n"
        f"Content-Length: {len(body)}\r\n\r\n"
    )
    return head.encode() + lead + body + b"\r\n\r\n"


def bodies(seed, n, size=2000):
    """Payloads of all lengths, with marks and headers of other records in them."""
    rng = random.Random(seed)
    trap = b"\nWARC/1.0\nWARC-Type: response\nContent-Length: 5\n\ntrap!\n"
    out = []
    for _ in range(n):
        body = rng.randbytes(rng.choice([0, 1, 2, 3, size, 2 * size])).replace(b"\r", b".").replace(b"\n", b".")
        out.append(body + rng.choice([b"", b"", trap, trap * 3]))
    return out


def whole_records(seed, n, size=2000):
    rng = random.Random(seed)
    return [
        record(f"r{i}", body, rng.choice(["response", "response", "request"]), rng.choice([b"", b"\r\n"]))
        for i, body in enumerate(bodies(seed, n, size))
    ]


def rows(frame):
    columns = ("record_no", "warc_type", "content_length", "headers", "content")
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=lambda r: r[0])


@pytest.mark.parametrize("record_type", ["response", ""])
def test_a_plain_file_in_pieces(spark, tmp_path, record_type):
    data = whole_records(1, 600, 30_000)
    path = tmp_path / "a.warc"
    path.write_bytes(b"junk\n" + b"".join(data))
    size = path.stat().st_size
    found = archive_pieces(spark, archive_files(spark, str(path)), record_type, size // 8).collect()
    found.sort(key=lambda r: r.start)
    assert len(found) == 8 and found[0].start == 0 and found[-1].end == size
    assert [r.end for r in found[:-1]] == [r.start for r in found[1:]]
    assert all(path.read_bytes()[r.start : r.start + 5] == b"WARC/" for r in found[1:])
    one = read_warc(spark, str(path), record_type, piece_bytes=1 << 40)
    cut = read_warc(spark, str(path), record_type, piece_bytes=size // 8)
    assert one.rdd.getNumPartitions() == 1
    assert len({r[0] for r in cut.select(F.spark_partition_id()).collect()}) > 2
    assert rows(cut) == rows(one)
    assert [r[0] for r in rows(cut)] == list(range(1, len(rows(one)) + 1))


@pytest.mark.parametrize("together", [1, 7])
def test_a_compressed_file_in_pieces(spark, tmp_path, together):
    """Members of one or several records, one of them an archive by itself, and padding."""
    data = whole_records(2, 400)
    inner = gzip.compress(record("inner", b"not a record of this file"))
    data[50] = record("outer", inner)
    members = [
        gzip.compress(b"".join(data[k : k + together]), compresslevel=0)
        for k in range(0, len(data), together)
    ]
    path = tmp_path / "a.warc.gz"
    path.write_bytes((b"\0" * 3).join(members))
    one = read_warc(spark, str(path), piece_bytes=1 << 40)
    cut = read_warc(spark, str(path), piece_bytes=50_000)
    assert archive_pieces(spark, archive_files(spark, str(path)), piece_bytes=50_000).count() > 5
    assert rows(cut) == rows(one)
    assert "inner" not in {r[3]["WARC-TREC-ID"] for r in rows(cut)}


def test_members_that_do_not_begin_with_a_record(spark, tmp_path):
    """A stream cut into members anywhere has no place to start at but its beginning."""
    stream = b"".join(whole_records(3, 100))
    members = [gzip.compress(stream[k : k + 777]) for k in range(0, len(stream), 777)]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(members))
    (tmp_path / "b.warc").write_bytes(stream)
    found = archive_pieces(spark, archive_files(spark, str(path)), piece_bytes=2000).collect()
    assert len(found) < 5
    cut = read_warc(spark, str(path), piece_bytes=2000)
    assert rows(cut) == rows(read_warc(spark, str(tmp_path / "b.warc")))


def test_headers_only(spark, tmp_path):
    data = b"".join(whole_records(4, 200))
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data))
    for name in ("a.warc", "b.warc.gz"):
        path = str(tmp_path / name)
        full = read_warc(spark, path)
        bare = read_warc(spark, path, payload=False, piece_bytes=20_000)
        assert [r[:4] for r in rows(bare)] == [r[:4] for r in rows(full)]
        assert bare.where("content IS NOT NULL").count() == 0


def test_payloads_are_passed_over_without_reading():
    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            data = super().read(n)
            self.taken += len(data)
            return data

    raw = Counted(record("a", b"x" * 5_000_000) + record("b", b"y" * 5_000_000))
    size = len(raw.getbuffer())
    stream = io.BufferedReader(parsing.Stretch(raw, 0, size), 1 << 16)
    found = list(parsing.records(stream, "response", payload=False))
    assert [r["content_length"] for r in found] == [5_000_000] * 2
    assert raw.taken < 500_000


@pytest.mark.parametrize("cut", [1, 200, 60_000])
def test_what_is_lost_is_told(spark, tmp_path, cut):
    data = whole_records(5, 60)
    plain, packed = b"".join(data), b"".join(map(gzip.compress, data))
    for name, content in (("good.warc", plain), ("good.warc.gz", packed), ("blank.warc", b"\n\n"), ("empty.warc", b"")):
        (tmp_path / name).write_bytes(content)
    (tmp_path / "cut.warc").write_bytes(plain[: -4 - cut])
    (tmp_path / "cut.warc.gz").write_bytes(packed[:-cut])
    (tmp_path / "broken.warc.gz").write_bytes(packed + b"no member")
    told = {r.path.rsplit("/", 1)[1]: r for r in archive_report(spark, str(tmp_path)).collect()}
    assert {name: r.whole for name, r in told.items()} == {
        "good.warc": True, "good.warc.gz": True, "blank.warc": True,
        "cut.warc": False, "cut.warc.gz": False, "broken.warc.gz": False,
    }
    every = read_warc(spark, str(tmp_path), "").groupBy("path").count().collect()
    assert {r.path.rsplit("/", 1)[1]: r["count"] for r in every} == {
        name: r.n_records for name, r in told.items() if r.n_records
    }
    assert told["good.warc"].n_records == 60 and told["broken.warc.gz"].n_records == 60


def test_many_small_files_and_a_few_large_ones(spark, tmp_path, monkeypatch):
    """Tasks get files of about the same cost, in order, also when one task cannot order them."""
    for k in range(1500):
        (tmp_path / f"{k:05d}.warc").write_bytes(record(f"s{k}", b"x") if k % 10 == 0 else b"\n")
    large = b"".join(whole_records(6, 150))
    for k in range(3):
        (tmp_path / f"large{k}.warc").write_bytes(large)
    expected = 150 + 3 * read_warc(spark, str(tmp_path / "large0.warc")).count()
    for ordered in (10_000, 400):
        monkeypatch.setattr(warc, "ORDERED_ROWS", ordered)
        frame = read_warc(spark, str(tmp_path), piece_bytes=100_000)
        assert frame.rdd.getNumPartitions() < 1600
        ids = frame.select("path", "record_no").collect()
        assert len(ids) == len(set(ids)) == expected
    listed = archive_files(spark, str(tmp_path))
    assert listed.count() == 1503


@pytest.mark.parametrize("packed", [False, True])
def test_short_pieces_share_tasks(spark, tmp_path, packed):
    """Tasks are for bytes: a piece that follows another in its file is no file to open."""
    data = whole_records(7, 600)
    for name in ("a", "b"):
        path = tmp_path / f"{name}.warc{'.gz' * packed}"
        path.write_bytes(b"".join(gzip.compress(d, 0) for d in data) if packed else b"".join(data))
    found = archive_pieces(spark, archive_files(spark, str(tmp_path)), piece_bytes=2000)
    assert found.count() > 300
    cut = read_warc(spark, str(tmp_path), piece_bytes=2000)
    assert cut.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    for path in sorted(tmp_path.iterdir()):
        one = read_warc(spark, str(path), piece_bytes=1 << 40)
        assert rows(cut.where(F.col("path").endswith(path.name))) == rows(one)
