import random

import numpy as np

import corpus_pipeline
from loomwork.llm import simhash


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_stage_keeps_one_of_near_copies(spark):
    r = random.Random(4)
    say = lambda n: [f"w{r.randint(0, 400)}" for _ in range(n)]
    texts = [say(r.randint(1, 120)) for _ in range(40)]
    for k in range(40):
        own = list(texts[k])
        for _ in range(r.randint(1, 3)):
            own[r.randrange(len(own))] = "changed"
        texts.append(own)
    line = "this same line of a license stands in each of these documents".split()
    texts += [[*line, *say(40)] for _ in range(30)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(500, None), (501, ""), (None, " ".join(texts[3])), (None, "nowhere else at all but here")]
    table = spark.createDataFrame([(*x, "en") for x in rows], "doc_id long, text string, lang string")
    kept = corpus_pipeline.one_of_each(spark, table, "").collect()
    own = {(x.doc_id, x.text): shingles(x.text) for x in kept}
    assert len(own) == len(kept)
    alike = lambda a, b: a == b or len(a & b) * 5 >= 4 * len(a | b)
    assert not [1 for a in own for b in own if a != b and alike(own[a], own[b])]
    # what isn't kept has a copy that comes earlier; nothing else goes
    for d, t in rows:
        if (d, t) not in own:
            assert any(alike(shingles(t), shingles(u)) and (e is None, e or 0) <= (d is None, d or 0) and (e, u) != (d, t) for e, u in rows)
    assert (None, "nowhere else at all but here") in own
    assert sum(alike(shingles(a), shingles(b)) for (_, a), (_, b) in zip(rows[:40], rows[40:80])) > 10


def test_repeated_ids_keep_their_own_texts(spark):
    rows = [(1, "one two three four five", 1.0), (5, "one two three four five", 2.0), (5, "totally other words here now then", 3.0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, k1 double")
    for keep in (simhash.keep_representatives, simhash.keep_one_of_each):
        assert sorted(tuple(x) for x in keep(table).collect()) == [rows[0], rows[2]]
    nulls = spark.createDataFrame([(7, None, None), (8, " ", None), (9, "", None)], table.schema)
    assert sorted(x.doc_id for x in simhash.keep_one_of_each(table.union(table).union(nulls)).collect()) == [1, 5, 7]
    assert simhash.keep_one_of_each(table.limit(0)).collect() == []


def test_families_and_shared_passages(spark, monkeypatch):
    """Families of near copies, a passage that most documents share, clashing names; small blocks, no broadcast, few shingles put last."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 3)
    monkeypatch.setattr(simhash, "BROADCAST_IDS", 0)
    r = random.Random(8)
    say = lambda n: [f"w{r.randint(0, 300)}" for _ in range(n)]
    passage, texts = say(30), []
    for _ in range(6):
        base = say(r.randint(30, 90))
        for _ in range(15):
            own = list(base)
            for _ in range(r.randint(0, 2)):
                own[r.randrange(len(own))] = f"w{r.randint(0, 300)}"
            texts.append(own)
    texts += [[*say(r.randint(5, 40)), *passage, *say(3)] for _ in range(60)]
    texts = [" ".join(t) for t in texts]
    r.shuffle(texts)
    sets = [shingles(t) for t in texts]
    near = {i: [j for j in range(len(texts)) if len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])] for i in range(len(texts))}
    root = {}
    for i in range(len(texts)):
        todo = [] if i in root else [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in root:
                    root[j] = i
                    todo.append(j)
    for last in (simhash.LAST, 5):
        monkeypatch.setattr(simhash, "LAST", last)
        table = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, k1 string, `a.b` string")
        kept = simhash.keep_one_of_each(table)
        assert kept.columns == table.columns
        # fingerprints of five-word shingles within two bits link nothing here that sets don't
        assert sorted(x.doc_id for x in kept.collect()) == sorted(set(root.values()))


def test_walk_prunes():
    """On random values nearly all pairs of nodes are dropped above the leaves, and every link is found."""
    rng = np.random.default_rng(1)
    v = np.unique(np.concatenate([x := rng.integers(0, 2**63, 3000, dtype=np.uint64), x[:500] ^ np.uint64(1 << 40), x[:500] ^ np.uint64(3)]))
    walk = simhash.Walk(v)
    i, j = walk.links()
    near = np.bitwise_count(v[:, None] ^ v[None]) <= 2
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a, b in zip(*(x.tolist() for x in np.nonzero(near))) if a < b}
    assert walk.pruned > 1000 and walk.visited > len(v) and walk.compared < len(v) ** 2 / 2 / 25
