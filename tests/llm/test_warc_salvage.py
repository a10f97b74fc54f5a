"""Archives of other writers, damaged: later records come back, and only damaged bytes are gaps."""

import gzip
import io
import random

import pytest

from usagelens.llm import warc


def named(data, name="page.warc"):
    """A member as Python's gzip module writes it: with a file name and a time."""
    out = io.BytesIO()
    with gzip.GzipFile(name, "wb", mtime=7, fileobj=out) as f:
        f.write(data)
    return out.getvalue()


def extra(data):
    """A member with an extra field and a comment."""
    plain = bytearray(gzip.compress(data, mtime=0))
    plain[3] = 4 | 16
    return bytes(plain[:10]) + (3).to_bytes(2, "little") + b"abc" + b"said\x00" + bytes(plain[10:])


def body(i):
    return f"<p>{i}</p>".encode() * (i % 7 + 1) + random.Random(i).randbytes(200 * (i % 5))


def record(i):
    return warc.record(i, f"http://x/{i}", body(i), None, False)


def archive(tmp_path, parts, name="crawl.warc.gz"):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / name).write_bytes(b"".join(parts))
    return str(tmp_path / "in")


@pytest.mark.parametrize("range_bytes", [97, 1 << 24])
def test_members_of_any_flags(spark, tmp_path, range_bytes):
    """Members with names, extra fields and none, an empty one, two records in one; damage, noise and a cut end."""
    parts = [(named if i % 3 else extra if i % 2 else gzip.compress)(record(i)) for i in range(12)]
    parts[4] = named(record(4) + record(40))
    parts.insert(5, gzip.compress(b""))  # record i > 4 is part i + 1 now
    starts = [sum(map(len, parts[:k])) for k in range(len(parts) + 1)]
    data = bytearray(b"".join(parts))
    data[starts[7] + 60] ^= 0x55  # record 6
    del data[starts[12] + 40:]  # record 11
    noise = b"\x1f\x8b\x08\x00 noise \x1f\x8b\x08\xff"
    data[starts[9]: starts[9]] = noise
    found, gaps = warc.read(spark, archive(tmp_path, [bytes(data)]), range_bytes=range_bytes)
    got = {r["page_id"]: bytes(r["payload"]) for r in found.collect()}
    assert got == {i: (body(i)) for i in [*range(12), 40] if i not in (6, 11)}
    logged = sorted((r["start"], r["end"]) for r in gaps.collect())
    assert logged == [(starts[7], starts[8]), (starts[9], starts[9] + len(noise)), (starts[12] + len(noise), starts[12] + len(noise) + 40)]


def test_part_of_a_member(spark, tmp_path):
    """A member that inflates with a broken record between good ones keeps those and is logged."""
    broken = record(2).replace(b"Content-Length: ", b"Content-Lenght: ")
    parts = [named(record(1)), named(record(5) + broken + record(6)), named(record(3))]
    found, gaps = warc.read(spark, archive(tmp_path, parts))
    assert sorted(r["page_id"] for r in found.collect()) == [1, 3, 5, 6]
    (gap,) = gaps.collect()
    assert (gap["start"], gap["end"], gap["reason"]) == (len(parts[0]), len(parts[0]) + len(parts[1]), "no content length")


@pytest.mark.parametrize("range_bytes", [64, 1 << 24])
def test_an_archive_in_an_archive(spark, tmp_path, range_bytes):
    """A payload that holds whole records and members, stored as they are, gives no records of its own."""
    inner = named(record(7)) + record(8) + b"\x1f\x8b\x08\x00"
    outer = warc.record(1, "u", inner, None, False)
    stored = gzip.compress(outer, compresslevel=0, mtime=0)
    found, gaps = warc.read(spark, archive(tmp_path, [stored, named(record(2))]), range_bytes=range_bytes)
    assert sorted(r["page_id"] for r in found.collect()) == [1, 2] and gaps.count() == 0
    (tmp_path / "in" / "crawl.warc.gz").rename(tmp_path / "in" / "kept")
    (tmp_path / "in" / "kept").write_bytes(outer + record(3))
    found, gaps = warc.read(spark, str(tmp_path / "in"), members=False, range_bytes=range_bytes)
    assert sorted(r["page_id"] for r in found.collect()) == [1, 3] and gaps.count() == 0


def test_nothing_to_read(spark, tmp_path):
    """Files without openings are one gap each; empty files and heads without an end give nothing."""
    archive(tmp_path, [b"no archive at all"], "a.warc")
    archive(tmp_path, [], "b.warc.gz")
    folder = archive(tmp_path, [b"\x1f\x8b\x08\x00" * 50], "c")
    found, gaps = warc.read(spark, folder, range_bytes=40)
    assert found.count() == 0 and sorted((r["start"], r["end"], r["reason"]) for r in gaps.collect()) == [(0, 17, "no opening"), (0, 200, "damaged member")]
