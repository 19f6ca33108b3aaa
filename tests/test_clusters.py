"""Greedy stars over whole tables against a plain version."""

from pathlib import Path

import numpy as np
import pytest

from engram.operators import similarity
from engram.plans import catalogue

SF = "/root/testdata/sf0.001"


def stars(pairs):
    """cluster -> (members, similarity) by going through the ids one by one."""
    later = {}
    for a, b, s in pairs:
        later.setdefault(a, {})[b] = s
    taken, out = set(), {}
    for seed in sorted(later):
        free = {} if seed in taken else {b: s for b, s in later[seed].items() if b not in taken}
        if free:
            taken |= {seed, *free}
            out[seed] = ({seed, *free}, float(np.floor(max(free.values()) * 100 + 0.5) / 100))
    return out


def found(rows):
    out = {}
    for r in rows:
        ids, best = out.setdefault(r.cluster, (set(), r.similarity))
        assert r.id not in ids and r.similarity == best
        ids.add(r.id)
    return out


def alike(ids, vectors, at_least):
    v = np.array(vectors, float)
    s = v @ v.T / np.outer(n := np.linalg.norm(v, axis=1), n)
    return [(ids[i], ids[j], s[i, j]) for i in range(len(ids)) for j in range(len(ids)) if ids[i] < ids[j] and s[i, j] >= at_least]


@pytest.mark.parametrize("folded", [0, 7, 100_000])
def test_stars_of_any_component(spark, monkeypatch, folded):
    monkeypatch.setattr(similarity, "FOLDED", folded)
    rng = np.random.default_rng(5)
    pairs = {(int(a), int(b)) for a, b in np.sort(rng.integers(0, 120, (260, 2))) if a < b}
    pairs |= {(i, i + 1) for i in range(200, 214)} | {(300, i) for i in range(301, 330)} | {(i, 400) for i in range(390, 400)}
    rows = [(a, b, float(s)) for (a, b), s in zip(sorted(pairs), rng.random(len(pairs)), strict=True)]
    got = similarity.star_clusters(spark.createDataFrame(rows, similarity.PAIRS).repartition(3))
    assert found(got.collect()) == stars(rows)
    assert similarity.star_clusters(spark.createDataFrame([], similarity.PAIRS)).count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_clusters_reach_every_row(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = stars(alike([r.vec_id for r in rows], [r.embedding for r in rows], 0.35))
    assert max(max(ids) for ids, _ in want.values()) >= 200
    assert found(catalogue.queries()["dup_clusters"](spark, SF).collect()) == want
    said = {r.id: r.description for r in catalogue.queries()["recommendations"](spark, SF).collect()}
    assert said["rec-duplication"] == f"{len(want)} groups with {sum(len(ids) for ids, _ in want.values())} members"
