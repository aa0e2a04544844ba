import hashlib

import numpy as np
import pyarrow as pa

from loomwork.llm import exactdedup


def run_of(rows):
    return pa.RecordBatch.from_pylist([dict(zip(exactdedup._SCHEMA.names, r)) for r in rows], schema=exactdedup._SCHEMA)


def test_multiway_merge_of_sorted_runs():
    """Blocks of a few rows, keys that many runs share, ids that are null, one sha256 with two second hashes."""
    rng = np.random.default_rng(3)
    pool = sorted((hashlib.sha256(bytes([k // 2])).digest(), [-5, 7][k % 2], k % 3) for k in range(80))
    runs, want = [], {}
    for _ in range(5):
        own = [pool[k] for k in np.flatnonzero(rng.random(len(pool)) < 0.5)]
        rows = [(*key, None if rng.random() < 0.3 else int(rng.integers(-9, 99)), int(rng.integers(1, 4))) for key in own]
        for *key, first, n in rows:
            ids, total = want.get(tuple(key), ([], 0))
            want[tuple(key)] = (ids + [first] * (first is not None), total + n)
        runs.append(rows)
    runs.append([])

    def blocks(rows, size):
        for k in range(0, len(rows), size):
            yield exactdedup.Block.of(run_of(rows[k : k + size]))

    for size in (1, 3, 1000):
        got = [tuple(r.values()) for b in exactdedup.merged([blocks(r, size) for r in runs]) for r in b.batch().to_pylist()]
        assert got == [(*key, min(ids, default=None), n) for key, (ids, n) in sorted(want.items())]


def test_slices_and_rounds(spark):
    texts = [f"text {k % 700}" for k in range(2000)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = exactdedup.digests(docs)
    runs = rows.groupBy("run", *exactdedup._KEYS).agg({"doc_id": "min", "*": "count"}).withColumnRenamed("min(doc_id)", "first").withColumnRenamed("count(1)", "n")
    got = exactdedup.tree_merge(runs, slice_rows=40).collect()
    assert sorted((bytes(x.sha), x["first"], x.n) for x in got) == sorted((hashlib.sha256(f"text {k}".encode()).digest(), k, len(range(k, 2000, 700))) for k in range(700))
