import random
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from loomwork.llm import decontaminate, quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with good and bad documents, copies, near copies, passages of the benchmark, nulls, and ids that repeat."""
    r, path = random.Random(11), str(tmp_path_factory.mktemp("tables"))
    say = lambda n: [f"w{r.randint(0, 500)}" for _ in range(n)]
    passages = [" ".join(say(14)) for _ in range(3)]
    docs, labels = [], []
    for k in range(150):
        good = k % 4 > 0
        text = " ".join(say(r.randint(20, 60))) if good else " ".join(f"{w.upper()}!!" for w in say(30))
        docs.append((k, text))
        if k % 2:
            labels.append((k, int(good)))
    docs += [(200 + k, docs[4 * k + 1][1]) for k in range(10)]
    for k in range(10):
        own = docs[4 * k + 2][1].split() * 3
        docs += [(300 + 2 * k, " ".join(own)), (301 + 2 * k, " ".join([*own[:-1], "changed"]))]
    docs += [(400 + k, " ".join([*say(20), passages[k % 3], *say(20)])) for k in range(9)]
    docs += [(500, None), (501, ""), (7, "another text under a number that is there already " * 3)]
    table = spark.createDataFrame([(d, t, "en", f"s{d % 3}", len(t or "")) for d, t in docs], COLUMNS)
    table.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def key(d, t):
    return d, t or None


def test_stages_one_after_another(spark, folder):
    """Each stage on all that the one before kept, against plain Python on the same rows; then run() as a whole."""
    docs, stages = spark.read.parquet(f"{folder}/documents.parquet"), corpus_pipeline.STAGES
    rows = [tuple(x) for x in docs.collect()]
    named = dict(zip(("good", "near", "clean", "mix", "shards"), (f for _, f in stages)))
    good = named["good"](spark, docs, folder)
    scored = {(x.doc_id, x.text) for x in good.collect()}
    weights = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    sure = quality.batch_scores(__import__("pyarrow").array([t for _, t, *_ in rows]), weights)
    assert scored == {(d, t) for (d, t, *_), p in zip(rows, sure.tolist()) if p >= 0.5}

    good = spark.createDataFrame(good.collect(), docs.schema)
    near = named["near"](spark, good, folder).collect()
    own = sorted((d, t) for d, t in scored if t) + sorted((d, t or "") for d, t in scored if not t)
    sets, want = [shingles(t) for _, t in own], []
    for i, (d, t) in enumerate(own):
        first = next(j for j in range(len(own)) if sets[i] == sets[j] or len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]))
        if first == i:
            want.append(key(d, t))
    assert sorted(map(str, (key(x.doc_id, x.text) for x in near))) == sorted(map(str, want))

    near = spark.createDataFrame(near, docs.schema)
    clean = named["clean"](spark, near, folder).collect()
    assert sorted(x.doc_id for x in clean) == sorted(d for d, _ in want if not 400 <= d < 410)

    clean = spark.createDataFrame(clean, docs.schema)
    mix = named["mix"](spark, clean, folder)
    assert mix.columns == docs.columns
    times = Counter((x.doc_id, x.text) for x in mix.collect())
    assert max(times.values()) <= 2 and set(times) <= {(x.doc_id, x.text) for x in clean.collect()}

    mix = spark.createDataFrame(mix.collect(), docs.schema)
    placed = named["shards"](spark, mix, folder).collect()
    n = len(placed)
    assert sorted((x.shard, x.slot) for x in placed) == sorted((p % 8, p // 8) for p in range(n))
    assert Counter((x.doc_id, x.text_crc32) for x in placed) == Counter((x.doc_id, zlib.crc32((x.text or "").encode())) for x in mix.collect())
    whole = corpus_pipeline.run(spark, folder).collect()
    assert Counter((x.doc_id, x.text_crc32) for x in whole) == Counter((x.doc_id, x.text_crc32) for x in placed)


def test_empty_tables(spark, folder):
    none = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).collect() == []
