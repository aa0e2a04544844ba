import random

import pytest
from pyspark.sql import functions as F

from loomwork.llm import linededup as L


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(r, text, n):
    out = list(text)
    for _ in range(n):
        k, kind = r.randint(0, len(out)), r.random()
        if kind < 0.33:
            out.insert(k, r.choice("abcx"))
        elif out and kind < 0.66:
            out.pop(min(k, len(out) - 1))
        elif out:
            out[min(k, len(out) - 1)] = r.choice("abcx")
    return "".join(out)


@pytest.mark.parametrize("errors", [1, 2, 3])
def test_banded_distance(spark, errors):
    r = random.Random(errors)
    pairs = []
    for _ in range(1200):
        a = "".join(r.choice("abé") for _ in range(r.choice([0, 1, 2, 3, 5, 8, 24, 60, 120])))
        pairs.append((a, changed(r, a, r.randint(0, 5)) if r.random() < 0.8 else "".join(r.choice("abé") for _ in a)))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", L.banded_distance(F.col("a"), F.col("b"), errors).alias("d")).collect()
    for x in got:
        if abs(len(x.a) - len(x.b)) <= errors:
            assert min(x.d, errors + 1) == min(edits(x.a, x.b), errors + 1), x


def brute(docs, errors, shortest):
    first = {}
    for doc_id, text in docs:
        for line in (text or "").split("\n") if text else []:
            if len(line) >= shortest:
                first[line] = min(first.get(line, doc_id), doc_id)
    near = {a: [b for b in first if a != b and abs(len(a) - len(b)) <= errors and edits(a, b) <= errors] for a in first}
    return first, near


@pytest.mark.parametrize("most", [L.BROADCAST_HASHES, -1])
def test_report_against_all_pairs(spark, most, monkeypatch):
    monkeypatch.setattr(L.decisions, "__defaults__", (most,))
    r = random.Random(5)
    base = ["".join(r.choice("abcdefgh éü") for _ in range(r.randint(24, 70))) for _ in range(25)]
    docs = []
    for k in range(60):
        lines = [changed(r, r.choice(base), r.choice([0, 0, 1, 2, 2, 3])) for _ in range(r.randint(1, 4))]
        docs.append((k, "\n".join([*lines, r.choice(["ab", "", "cd"]), *lines[:1]])))
    docs += [(100, None), (101, ""), (102, base[0]), (102, base[0])]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, line string, h int")
    first, near = brute(docs, 2, 24)
    got = sorted((x.doc_id, x.n_lines, x.n_links) for x in L.line_report(frame).collect())
    want = sorted((d, len(t.split("\n")) if t else 0, sum(len(near[x]) for x in {x for x in (t or "").split("\n") if len(x) >= 24})) for d, t in docs)
    assert got == want
    assert sum(x[2] for x in got) > 50
    # a kept line has no equal or linked line in an earlier document
    for row in L.dedup_lines(frame).collect():
        for line in (row.text or "").split("\n"):
            if len(line) >= 24:
                assert first[line] == row.doc_id
                assert all(first[b] >= row.doc_id for b in near[line])
    kept = {x for row in L.dedup_lines(frame).collect() for x in (row.text or "").split("\n")}
    for line in first:
        assert line in kept or any(first[b] <= first[line] for b in near[line])


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert L.line_report(none).collect() == []
    assert L.dedup_lines(none).collect() == []
