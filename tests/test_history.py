"""Line ranges and renamed files against plain replays of generated histories."""

import gc
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from engram.operators import history as H
from engram.operators import retrieval as R
from engram.sources import code_files as CF


def edited(rnd, lines, serial):
    """A later version of some lines, and the hunks (old_start, old_count, new_start, new_count) that made it."""
    new, hunks, i = [], [], 0
    for _ in range(rnd.randint(1, 3)):
        keep = rnd.randint(1 if hunks else 0, max(1, len(lines) // 2))
        if i + keep > len(lines):
            break
        new += lines[i : i + keep]
        i += keep
        gone, added = rnd.choice([(0, 1), (0, 4), (2, 0), (1, 1), (3, 2), (1, 5)])
        gone = min(gone, len(lines) - i)
        if not gone and not added:
            continue
        old_start, new_start = i + (1 if gone else 0), len(new) + (1 if added else 0)
        hunks.append((old_start, gone, new_start, added))
        new += [next(serial) for _ in range(added)]
        i += gone
    return new + lines[i:], hunks


def replayed(versions, hunks, first, last):
    """The commits, from the newest, that touch a range, by where each line was; versions and hunks from the oldest."""
    out = []
    for k in range(len(hunks) - 1, -1, -1):
        old, new = versions[k], versions[k + 1]
        inside = set(range(first, last + 1))
        was = {x: i + 1 for i, x in enumerate(old)}
        lines = {was[new[i - 1]] for i in inside if new[i - 1] in was}
        touched = False
        for a, m, b, n in hunks[k]:
            if n and inside & set(range(b, b + n)) or not n and first <= b < last:
                touched = True
                lines |= set(range(a, a + m))
        if touched:
            out.append(k)
        if not lines:
            break
        first, last = min(lines), max(lines)
    return out


@pytest.mark.parametrize("folded", [256, 3])
def test_line_history(spark, monkeypatch, folded):
    monkeypatch.setattr(H, "FOLDED", folded)
    rnd, rows, ranges, want = random.Random(5), [], [], {}
    for p in range(12):
        serial = iter(range(10**6))
        versions, made = [[next(serial) for _ in range(rnd.randint(3, 40))]], []
        for _ in range(rnd.randint(1, 25)):
            new, hunks = edited(rnd, versions[-1], serial)
            versions.append(new)
            made.append(hunks)
        for k, hunks in enumerate(made):
            rows += [(f"f{p}", len(made) - 1 - k, f"c{k}", f"a{k % 3}", 20200101 + k, *h) for h in hunks]
        for _ in range(8):
            if versions[-1]:
                first = rnd.randint(1, len(versions[-1]))
                last = rnd.randint(first, len(versions[-1]))
                ranges.append((len(ranges), f"f{p}", first, last))
                want[len(ranges) - 1] = [f"c{k}" for k in replayed(versions, made, first, last)]
    hunks = spark.createDataFrame(rows, "path string, seq long, commit string, author string, date long, old_start int, old_count int, new_start int, new_count int")
    table = spark.createDataFrame([*ranges, (999, "none", 1, 5)], "id long, path string, first int, last int")
    got = {}
    for r in H.line_history(hunks, table).orderBy("id", "seq").collect():
        got.setdefault(r.id, []).append(r.commit)
        assert r.author == f"a{int(r.commit[1:]) % 3}" and r.date == 20200101 + int(r.commit[1:])
    assert got == {i: w for i, w in want.items() if w} and sum(map(len, got.values())) > 150
    assert H.line_history(hunks.limit(0), table).count() == 0 and H.line_history(hunks, table.limit(0)).count() == 0


@pytest.mark.parametrize("whole,passes", [(4096, 1), (4096, 3), (9, 2), (0, 1)])
def test_line_history_of_common_paths(spark, monkeypatch, whole, passes):
    """Paths folded at once and paths folded in rounds, in several passes, give the same, and no shuffle files stay."""
    monkeypatch.setattr(H, "FOLDED", 4)
    monkeypatch.setattr(H, "WHOLE", whole, raising=False)
    rnd, rows, ranges, want = random.Random(8), [], [], {}
    for p in range(9):
        serial = iter(range(10**6))
        versions, made = [[next(serial) for _ in range(30)]], []
        for _ in range(2 + 3 * p):
            new, hunks = edited(rnd, versions[-1], serial)
            versions.append(new)
            made.append(hunks)
        for k, hunks in enumerate(made):
            rows += [(p, len(made) - 1 - k, k, p, 20200101 + k, *h) for h in hunks]
        for first in range(1, len(versions[-1]), 7):
            ranges.append((len(ranges), p, first, min(first + 9, len(versions[-1]))))
            want[len(ranges) - 1] = replayed(versions, made, *ranges[-1][2:])
    hunks = spark.createDataFrame(rows, "path long, seq long, commit long, author long, date long, old_start int, old_count int, new_start int, new_count int")
    table = spark.createDataFrame(ranges, "id long, path long, first int, last int")
    files = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before, got = files(), {}
    found = H.line_history(hunks, table, **({"passes": passes} if passes > 1 else {}))
    assert whole < 4096 or files() <= before
    for r in found.orderBy("id", "seq").collect():
        got.setdefault(r.id, []).append(r.commit)
    assert got == {i: w for i, w in want.items() if w} and got


def test_an_insertion_above(spark):
    """Lines that come in above a symbol move it; commits to where it stands now aren't its own."""
    rows = [("f", 0, "top", "x", 3, 0, 0, 1, 10), ("f", 1, "body", "y", 2, 5, 1, 5, 1), ("f", 2, "other", "z", 1, 15, 1, 15, 1)]
    hunks = spark.createDataFrame(rows, "path string, seq long, commit string, author string, date long, old_start long, old_count long, new_start long, new_count long")
    got = H.line_history(hunks, spark.createDataFrame([(1, "f", 14, 16)], "id long, path string, first long, last long")).collect()
    assert [r.commit for r in got] == ["body"]


def test_numbered(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice("aaaab"), s) for s in rnd.sample(range(-500, 10**6), 400)]
    got = {(r.k, r.s): r.nth for r in H.numbered(spark.createDataFrame(rows, "k string, s long"), "k", "s").collect()}
    assert got == {(k, s): sorted(x for j, x in rows if j == k).index(s) for k, s in rows}


def test_followed(spark):
    """Files that change names, give them up, swap them and take others' over, against a replay by identity."""
    rnd = random.Random(11)
    for chain in (False, True):
        names, renames, touches, life, truth = {}, [], [], {}, []
        names = {i: f"n{i}" for i in range(8)}
        for t in range(120):
            seq = 1000 - t
            if chain:
                i = 0
                new = f"chain{t}"
                renames.append((seq, names[i], new))
                names[i] = new
                moved = {i}
            elif rnd.random() < 0.3 and len(names) > 1:  # two swap
                i, j = rnd.sample(sorted(names), 2)
                renames += [(seq, names[i], names[j]), (seq, names[j], names[i])]
                names[i], names[j] = names[j], names[i]
                moved = {i, j}
            elif rnd.random() < 0.6:
                i = rnd.choice(sorted(names))
                new = f"n{rnd.randint(0, 12)}"
                over = [j for j, n in names.items() if n == new]
                if over == [i]:
                    continue
                renames.append((seq, names[i], new))
                for j in over:
                    del names[j]  # taken over
                names[i] = new
                moved = {i}
            else:
                moved = set()
            if not chain and rnd.random() < 0.2:  # a new file, often under a name that was given up
                free = [f"n{k}" for k in range(13) if f"n{k}" not in names.values() and not any(s == seq and f"n{k}" in (a, b) for s, a, b in renames)]
                used = {n for _, a, b in renames for n in (a, b)}
                free = [n for n in free if n in used or all(p != n for p, *_ in touches)]
                # A name that was given up without a rename would go on as the old file.
                free = [n for n in free if not [x for x in truth if x[1] == n] or n in used and names_free(renames, n)]
                if free:
                    i = max([*names, *(x[0] for x in truth)]) + 1
                    names[i] = free[0]
                    moved = moved | {i}
            for i in moved | {k for k in names if rnd.random() < 0.3}:
                touches.append((names[i], seq, f"c{t}-{i}"))
                truth.append((i, names[i], f"c{t}-{i}"))
        rows = H.followed(spark.createDataFrame(touches, "path string, seq long, commit string"), spark.createDataFrame(renames, "seq long, old string, new string")).collect()
        assert len(rows) == len(touches)
        of = {c: i for i, _, c in truth}
        groups = {}
        for r in rows:
            groups.setdefault((r.file, r.life), set()).add(of[r.commit])
        # One identity each, none in two; whoever still has a name ends up under it.
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({i for g in groups.values() for i in g})
        ended = {next(iter(g)): f for (f, _), g in groups.items()}
        assert all(ended[i] == n for i, n in names.items() if i in ended)
        if chain:
            assert ended[0] == "chain119" and sum(r.file == "chain119" for r in rows) == sum(i == 0 for i, *_ in truth)


def names_free(renames, name):
    """Whether the last rename of a name gave it up."""
    last = [(s, a, b) for s, a, b in renames if name in (a, b)]
    s = min(x[0] for x in last)
    return all(b != name for x, a, b in last if x == s)


def test_hunks_and_renames_of_a_log(spark):
    log = [
        ("h1|Ann|2024-01-02\n\ndiff --git a/x/f.ts b/x/f.ts\nindex 1..2\n--- a/x/f.ts\n+++ b/x/f.ts\n@@ -3 +3,2 @@ fn\n-a\n+b\n+@@ -9 +9 @@\n@@ -10,0 +12,4 @@\n+c\ndiff --git a/g.py b/g.py\n--- /dev/null\n+++ b/g.py\n@@ -0,0 +1,7 @@\n+x",),
        ("h2|Bo|2024-01-01\n\ndiff --git a/old.go b/old.go\n--- a/old.go\n+++ /dev/null\n@@ -1,5 +0,0 @@\n-y",),
        ("h3|Cy|2023-12-31\n",),
    ]
    df = spark.createDataFrame(log, "value string")
    got = sorted(map(tuple, CF.commit_hunks(df).collect()))
    assert got == [
        ("h1", "Ann", "2024-01-02", "g.py", 0, 0, 1, 7), ("h1", "Ann", "2024-01-02", "x/f.ts", 3, 1, 3, 2),
        ("h1", "Ann", "2024-01-02", "x/f.ts", 10, 0, 12, 4), ("h2", "Bo", "2024-01-01", "old.go", 1, 5, 0, 0),
    ]
    names = spark.createDataFrame([("h1|Ann|2024\nM\ta\nR087\told name\tnew name\nR100\tb\tc\nD\td",), ("h2|Bo|2023\nA\te",)], "value string")
    assert sorted(map(tuple, CF.commit_renames(names).collect())) == [("h1", "b", "c"), ("h1", "old name", "new name")]


def test_checkpoints_go(spark):
    """Nothing is left of ten queries' checkpoints once their frames are gone."""
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    docs = spark.createDataFrame([(i, f"the word{i % 7} of") for i in range(50)], "id long, text string")
    files = lambda: sum(p.is_file() for p in folder.rglob("rdd-*/*"))
    for _ in range(10):
        assert R.bm25(docs, ["word3"], 5).count() == 5
    for _ in range(40):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        if not files():
            break
        time.sleep(0.5)
    assert files() == 0
