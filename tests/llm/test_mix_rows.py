import random
from collections import Counter

from loomwork.llm import mixing


def test_taken_rows_find_their_texts_without_moving_them(spark, monkeypatch):
    """More taken rows than may be sent as such, but few blocks of 64 of them."""
    r = random.Random(5)
    rows = [(k // 2, " ".join(["w"] * r.randint(0, 30)) or None, r.choice(["a", "b", None])) for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 40)
    for epochs in (2, 3):
        taken = mixing.take(docs, epochs=epochs)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # Spark's own choice, of small tables only
        plan = taken._jdf.queryExecution().toString()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        keyed = docs.withColumn("n", mixing.F.length("text"))
        want = Counter()
        for x in mixing.mix(keyed, epochs=epochs, keep=("n",)).collect():
            want[x.doc_id, x.n, x.source] += x.copies
        assert Counter((x.doc_id, x.text and len(x.text), x.source) for x in taken.collect()) == +want
        assert max(want.values()) > 1
