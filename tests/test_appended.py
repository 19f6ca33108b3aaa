"""Files that grow, read on from byte offsets."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from engram.streaming import appended as A


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=120).map(lambda b: bytes(b"ab\n\xc3"[c % 4] for c in b)), st.integers(1, 40), st.integers(1, 9), st.integers(0, 60))
def test_ranges_give_every_line_once(tmp_path_factory, data, size, block, first):
    path = tmp_path_factory.mktemp("f") / "x"
    path.write_bytes(data)
    system, at = A.opened(str(path))
    end = A.whole_lines(system, at, len(data), block)
    assert end == data.rfind(b"\n") + 1
    first = data.rfind(b"\n", 0, min(first, end)) + 1  # where an earlier batch has ended
    got = [x for i in range(first, end, size) for x in A.lines_of(system, at, first, i, min(i + size, end), end, block)]
    want, place = [], first
    for line in data[first:end].split(b"\n")[:-1]:
        want.append((place, line))
        place += len(line) + 1
    assert got == want


def drain(spark, folder, out, seen, size=A.RANGE):
    q = A.appended_lines(spark, str(folder), ".jsonl", size=size).writeStream.format("parquet").option("checkpointLocation", str(out) + "-at").trigger(availableNow=True).start(str(out))
    q.awaitTermination()
    rows = sorted((r.path, r.begin, r.line) for r in spark.read.schema(A.SCHEMA).parquet(str(out)).collect())
    fresh = [r for r in rows if r not in seen]
    assert len(rows) == len(set(rows)) and len(fresh) + len(seen) == len(rows)
    seen.update(fresh)
    return fresh


@pytest.mark.parametrize("size", [A.RANGE, 7])
def test_only_appended_bytes_are_read(spark, tmp_path, size):
    folder, out, seen = tmp_path / "in", tmp_path / "out", set()
    (folder / "deep").mkdir(parents=True)
    (folder / "a.jsonl").write_bytes("one é\r\ntwo\npart".encode())
    (folder / "b.txt").write_text("no\n")
    (folder / "_c.jsonl").write_text("hidden\n")
    assert drain(spark, folder, out, seen, size) == [("a.jsonl", 0, "one é"), ("a.jsonl", 8, "two")]
    assert drain(spark, folder, out, seen, size) == []
    with (folder / "a.jsonl").open("ab") as f:
        f.write(b"ly\n\nlast\n")
    (folder / "deep" / "d.jsonl").write_text("x\n" * 5)
    fresh = [("a.jsonl", 12, "partly"), ("a.jsonl", 19, ""), ("a.jsonl", 20, "last"), *(("deep/d.jsonl", 2 * i, "x") for i in range(5))]
    assert drain(spark, folder, out, seen, size) == fresh  # another query each time: it goes on from the checkpoint
    (folder / "deep" / "d.jsonl").unlink()
    (folder / "a.jsonl").write_text("anew\n")
    assert drain(spark, folder, out, seen, size) == [("a.jsonl", 0, "anew")]
    assert sorted(r.line for r in A.appended_lines(spark, str(folder), ".jsonl", stream=False, size=size).collect()) == ["anew"]


def test_an_empty_folder(spark, tmp_path):
    assert A.appended_lines(spark, str(tmp_path / "none"), stream=False).count() == 0
    (tmp_path / "e.jsonl").write_text("")
    assert drain(spark, tmp_path, tmp_path / "out", set()) == []


def test_write_lines(spark, tmp_path):
    rows = [(f"f{i % 3}", i, f"l{i}", i > 8) for i in range(11)]
    for _ in range(2):
        A.write_lines(spark.createDataFrame(rows, "path string, nth long, line string, open boolean"), str(tmp_path))
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {"f0": "l0\nl3\nl6\nl9", "f1": "l1\nl4\nl7\nl10", "f2": "l2\nl5\nl8\n"}
