"""What a task of the vector operator holds: rows that do not grow with a shard, links within bounded memory."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspan.llm import hnsw


@pytest.mark.parametrize("element", ["float", "double"])
def test_no_row_grows_with_a_shard(spark, monkeypatch, element):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(1200, 16)).astype(np.float32).astype(float)
    rows[600:] = rows[:600] + np.float32(0.125)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    expected = (unit @ unit.T >= 0.9).sum(1) - 1
    kept, stage = {}, hnsw.stage

    def watched(frame, label, **options):
        kept[label] = stage(frame, label, **options)
        return kept[label]

    monkeypatch.setattr(hnsw, "stage", watched)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], f"vec_id long, embedding array<{element}>")
    got = {r["vec_id"]: r["n_links"] for r in hnsw.near_duplicates(frame, least_shards=2, recall=1.0).collect()}
    assert [got[k] for k in range(len(rows))] == expected.tolist()
    graphs = kept["hnsw-graphs"]
    binary = [F.coalesce(F.length(c), F.lit(0)) for c, kind in graphs.dtypes if kind == "binary"]
    assert graphs.select(F.max(sum(binary, F.lit(0)))).first()[0] < 1000
    assert graphs.count() == len(rows)


def linked(pairs):
    return {(row, place) for row, places in pairs for place in places.tolist()}


@pytest.mark.parametrize("same", [False, True])
def test_links_put_away_come_back_once(monkeypatch, same):
    monkeypatch.setattr(hnsw, "HELD", 300, raising=False)
    monkeypatch.setattr(hnsw, "WAITING", 200, raising=False)
    monkeypatch.setattr(hnsw, "BLOCK_CELLS", 900, raising=False)
    rng = np.random.default_rng(4)
    count, other = (90, 90) if same else (90, 70)
    pairs, expected = hnsw.Pairs(count, other, same), set()
    group = np.arange(20, 60)  # all linked with each other: bits; the others: places
    for row in range(count):
        places = group if row in group else rng.choice(other, 2, replace=False)
        pairs.add(row, places)
        expected |= {(row, p) for p in places.tolist()}
    for place in range(other):
        rows = group if place in group else rng.choice(count, 2, replace=False)
        pairs.add_back(place, rows)
        expected |= {(r, place) for r in rows.tolist()}
    if same:
        pairs, wanted = hnsw.Pairs(count, other, True), set()
        for row, place in sorted(expected):
            pairs.add(row, np.array([place]))
            wanted |= {(row, place), (place, row)} if row != place else set()
        expected = wanted
    assert linked(pairs) == expected


def test_links_of_large_shards_stay_in_bounded_memory():
    count = 40_000
    tracemalloc.start()
    pairs = hnsw.Pairs(count, count, False)
    for row in range(0, count, 4):
        pairs.add(row, np.array([row, (row * 7 + 1) % count]))
    for place in range(0, count, 4):
        pairs.add_back(place, np.array([place]))
    total = sum(len(places) for _, places in pairs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == count // 2
    assert peak < 60e6


def test_comparing_all_pairs_takes_bounded_memory():
    rng = np.random.default_rng(6)
    vectors = hnsw.unit(rng.normal(size=(40_000, 8)))
    tracemalloc.start()
    found = [len(x) for x in hnsw.compared(vectors, vectors[:256], 0.999)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == ((vectors[:256] @ vectors.T) >= 0.999).sum(1).tolist()
    assert peak < 30e6
