"""Files that grow, shrink, stay and end in half a line."""

import os

import pytest

from usagelens.sources import growing, transcripts


@pytest.fixture
def logs(tmp_path):
    folder = tmp_path / "in" / "projects" / "my proj"
    folder.mkdir(parents=True)
    return folder


def ingest(spark, tmp_path, **options):
    return growing.Ingest(spark, str(tmp_path / "in"), str(tmp_path / "state"), **options)


def held(job):
    return sorted((r["file_session_id"], r["line"]) for r in job.lines().collect())


def batch_of(job, n):
    return sorted(r["line"] for r in job.lines().where(f"batch = {n}").collect())


def test_append_shrink_half_line_and_unchanged(spark, tmp_path, logs):
    job = ingest(spark, tmp_path)
    assert job.committed() == 0 and job.lines().count() == 0
    (logs / "grows.jsonl").write_bytes(b'{"a":1}\n\n{"a":2}\n{"a":')
    (logs / "still.jsonl").write_bytes(b'{"s":1}\n')
    (logs / "shrinks.jsonl").write_bytes(b'{"x":1}\n{"x":2}\n{"x":3}\n')
    assert job.run() == 1
    assert held(job) == [("grows", '{"a":1}'), ("grows", '{"a":2}'), ("shrinks", '{"x":1}'), ("shrinks", '{"x":2}'), ("shrinks", '{"x":3}'), ("still", '{"s":1}')]
    with (logs / "grows.jsonl").open("ab") as f:
        f.write('3}\n{"é":4}\n'.encode())
    (logs / "shrinks.jsonl").write_bytes(b'{"y":1}\n')
    (logs / "new.jsonl").write_bytes(b'{"n":1}\n')
    assert job.run() == 2
    assert batch_of(job, 2) == ['{"a":3}', '{"n":1}', '{"y":1}', '{"é":4}']
    assert held(job) == [("grows", '{"a":1}'), ("grows", '{"a":2}'), ("grows", '{"a":3}'), ("grows", '{"é":4}'), ("new", '{"n":1}'), ("shrinks", '{"y":1}'), ("still", '{"s":1}')]
    assert job.run() == 3 and batch_of(job, 3) == []
    # the order column is the place in the file
    places = [r["line_no"] for r in job.lines().where("file_session_id = 'grows'").orderBy("line_no").collect()]
    assert places == [0, 9, 17, 25]
    assert transcripts.parse_lines(job.lines()).count() == 7


def test_ranges_cut_lines_nowhere(spark, tmp_path, logs):
    """Ranges of any size give every line once: line ends on range ends, lines over several ranges, empty lines, no end."""
    data = b"\n".join([b"x" * n for n in (0, 1, 2, 3, 9, 30, 0, 0, 5, 64, 7, 1)]) + b"\nhalf"
    (logs / "a.jsonl").write_bytes(data)
    path = str(logs / "a.jsonl")
    want = []
    at = 0
    for line in data.split(b"\n")[:-1]:
        want.append((at, line))
        at += len(line) + 1
    for begin in (0, 1, 3, 6):
        for width in range(1, 40):
            got = [x for s in range(begin, len(data), width) for x in growing.complete_lines(path, begin, s, min(s + width, len(data)), len(data), read_bytes=5)]
            assert got == [(a, x) for a, x in want if a >= begin], (begin, width)
    job = ingest(spark, tmp_path, range_bytes=16)
    job.run()
    assert sorted(r["line"] for r in job.lines().collect()) == sorted(x.decode() for _, x in want if x)


def test_a_run_that_died_is_repeated(spark, tmp_path, logs):
    """Lines of a batch without cursor are seen by nobody and replaced; a cursor without its end mark is no commit."""
    job = ingest(spark, tmp_path)
    (logs / "a.jsonl").write_bytes(b"1\n")
    job.run()
    (logs / "a.jsonl").write_bytes(b"1\n2\n")
    job.run()
    os.remove(tmp_path / "state" / "cursor" / "batch=2" / "_SUCCESS")
    assert job.committed() == 1 and held(job) == [("a", "1")]
    (logs / "a.jsonl").write_bytes(b"1\n2\n3\n")
    assert job.run() == 2 and held(job) == [("a", "1"), ("a", "2"), ("a", "3")]


def test_empty_and_missing_files(spark, tmp_path, logs):
    job = ingest(spark, tmp_path)
    (logs / "a.jsonl").write_bytes(b"1\n2\n")
    (logs / "e.jsonl").write_bytes(b"")
    job.run()
    (logs / "a.jsonl").write_bytes(b"")
    job.run()
    assert held(job) == [("a", "1"), ("a", "2")]  # like a file that is gone: what was read stays
    (logs / "a.jsonl").write_bytes(b"3\n")
    (logs / "e.jsonl").unlink()
    job.run()
    assert held(job) == [("a", "3")]
    job.run()
    assert held(job) == [("a", "3")]
