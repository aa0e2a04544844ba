import random

from loomwork.llm import linededup


def within(a, b, errors):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1] <= errors


def test_a_key_that_a_third_of_all_lines_has(spark, monkeypatch):
    """A hot segment, cut into blocks of three lines: n_links and n_kept against all pairs and plain order."""
    monkeypatch.setattr(linededup._in_blocks, "__defaults__", (3,))
    r = random.Random(5)
    base = "this segment stands at the start of very many lines, and then "
    lines = [base + f"{r.randint(0, 99):02d} ends {r.choice('abcd')}" for _ in range(60)]
    lines += ["".join(r.choice("abcdefgh ") for _ in range(r.randint(24, 60))) for _ in range(60)]
    lines += ["short", "", "short"]
    docs = [(k, "\n".join(r.choice(lines) for _ in range(r.randint(1, 5)))) for k in range(60)]
    first, near = {}, {}
    for k, t in docs:
        for x in t.split("\n"):
            first.setdefault(x, k)
    for a in first:
        near[a] = [b for b in first if a != b and min(len(a), len(b)) >= 24 and within(a, b, 2)]
    found = {x.doc_id: x for x in linededup.line_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(map(len, near.values())) > 100
    order = {x.line: (first[x.line], x.h) for x in linededup.hashed_lines(spark.createDataFrame(docs, "doc_id long, text string"), 0).distinct().collect()}
    for k, t in docs:
        own = t.split("\n")
        stays = [x for x in set(own) if x and first[x] == k and not any(order[b] < order[x] for b in near[x])]
        assert (found[k].n_lines, found[k].n_links, found[k].n_kept) == (len(own), sum(len(near[x]) for x in set(own)), len(stays) + ("" in own))
