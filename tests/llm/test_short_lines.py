import random

import pytest

from loomwork.llm import linededup as L


@pytest.mark.parametrize("most", [L.BROADCAST_HASHES, -1])
def test_short_lines_repeat_across_documents(spark, most, monkeypatch):
    monkeypatch.setattr(L.decisions, "__defaults__", (most,))
    r = random.Random(11)
    pool = ["Les.", "Des.", "x", " ", "All rights reserved.", "a line of 23 characters", "", "a line that is long enough to be linked", "another one, far from the one before it"]
    docs = [(k, "\n".join(r.choice(pool) for _ in range(r.randint(1, 5)))) for k in range(40)] + [(90, None), (91, ""), (92, "\n"), (93, "only here")]
    r.shuffle(docs)
    first = {}
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            first[line] = min(first.get(line, doc_id), doc_id)
    want = {d: None if t is None else [x for x in dict.fromkeys(t.split("\n")) if not x or first[x] == d] for d, t in docs}
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: x for x in L.line_report(table).collect()}
    assert {d: x.n_kept for d, x in got.items()} == {d: len(want[d]) if t else 0 for d, t in docs}
    assert all(x.n_links == 0 for x in got.values())
    assert {x.doc_id: x.text for x in L.dedup_lines(table).collect()} == {d: None if w is None else "\n".join(w) for d, w in want.items()}
