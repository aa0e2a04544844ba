import random

import pytest
from pyspark.sql import functions as F

from loomwork.llm import common, linededup


def edited(r, text, n):
    out = list(text)
    for _ in range(n):
        k, kind = r.randint(0, len(out)), r.choice("ids")
        if kind == "i":
            out.insert(k, r.choice("abé"))
        elif kind == "d":
            out.pop(min(k, len(out) - 1))
        else:
            out[min(k, len(out) - 1)] = r.choice("abé")
    return "".join(out)


@pytest.mark.parametrize("errors", [1, 2, 3])
def test_lines_to_be_linked_share_a_key(spark, errors):
    r = random.Random(errors)
    sizes = [*range(1, 40), *range(58, 70), *range(120, 148), 253, 254, 255, 256, 257, 300]
    pairs = []
    for size in sizes * 12:
        a = "".join(r.choice("abcdefghijklmnopqrstuvwxyz é") for _ in range(size))
        pairs.append((a, edited(r, a, r.randint(1, errors)) if size > errors else a))
    lines = [(2 * k + i, x, len(x)) for k, p in enumerate(pairs) for i, x in enumerate(p)]
    found = linededup.line_keys(spark.createDataFrame(lines, "h long, line string, size int"), errors).collect()
    keys = {}
    for x in found:
        keys.setdefault(x.h, set()).add(x.key)
    assert [p for k, p in enumerate(pairs) if not keys[2 * k] & keys[2 * k + 1]] == []
    if errors == 2:  # was 15 a line
        assert len(found) < 6 * len(lines)


def test_a_family_that_shares_a_segment_makes_few_pairs(spark, monkeypatch):
    """300 lines with one beginning and other ends: all pairs of them were written and fetched as texts before."""
    written, real = {}, common.materialise

    def told(df, name):
        out = real(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(common, "materialise", told)
    r = random.Random(3)
    base = "this beginning is shared by very many lines of one length, "
    lines = [base + "".join(r.choice("abcdefghinost e") for _ in range(60)) for _ in range(300)]
    lines += [edited(r, x, 2) for x in lines[:20]]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    links = {x.doc_id: x.n_links for x in linededup.line_report(docs).collect()}
    assert all(links[k] == links[300 + k] == (lines[k] != lines[300 + k]) for k in range(20))
    assert not any(links[k] for k in range(20, 300))
    assert written["pairs"] < 320 * 319 / 2 / 10


@pytest.mark.parametrize("most", [linededup.BROADCAST_HASHES, -1])
def test_equal_rows_count_once(spark, most, monkeypatch):
    monkeypatch.setattr(linededup.decisions, "__defaults__", (most,))
    a, b = "the first of two lines that two edits part", "the first of two lines that no edits part"
    rows = [(1, "x\nx\ny"), (1, "x\nx\ny"), (1, "\nz\nx\n"), (2, f"x\nw\n{a}"), (2, f"x\nw\n{a}"), (3, f"{b}\nw\nonly"), (None, "w\nq"), (None, "w\nq"), (4, "\n"), (5, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, F.rand(1))
    got = sorted(((x.doc_id or 0, x.n_lines, x.n_kept, x.n_links) for x in linededup.line_report(table).collect()))
    assert got == sorted([(1, 3, 2, 0), (1, 3, 2, 0), (1, 4, 3, 0), (2, 3, 2, 1), (2, 3, 2, 1), (3, 3, 1, 1), (0, 2, 1, 0), (0, 2, 1, 0), (4, 2, 1, 0), (5, 0, 0, 0)])
