import pytest

from loomwork.llm import decontaminate, linededup, mixing, quality, simhash

NAMES = "copies _row _times _copy _gone _d _dn _h _k1 k1 k2 key line a.b".split()
SCHEMA = "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in NAMES)


@pytest.fixture(scope="module")
def table(spark):
    texts = ["one two three four five six seven", None, "", "one two three four five six seven", "a line that stands in two documents here\nown", "a line that stands in two documents here\nother"]
    return spark.createDataFrame([(k, t, "ab"[k % 2], *(f"{n}{k}" for n in NAMES)) for k, t in enumerate(texts)], SCHEMA)


def whole(rows, table):
    """Every row is one of the table's, but for its text."""
    own = {x.doc_id: x for x in table.collect()}
    for x in rows:
        assert x.asDict() | {"text": ""} == own[x.doc_id].asDict() | {"text": ""}


def test_rows_come_back_whole(spark, table, monkeypatch):
    taken = mixing.take(table)
    bench = spark.createDataFrame([(1, "two three four")], "item_id long, text string")
    clean = [decontaminate.keep_clean(table, bench, most) for most in (1000, 0)]
    lines = linededup.dedup_lines(table)
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(map(str, mixing.take(table).collect())) == sorted(map(str, taken.collect()))
    kept = simhash.keep_one_of_each(table)
    for found in (taken, *clean, lines, kept):
        assert found.columns == table.columns
        whole(found.collect(), table)
    assert sorted(x.doc_id for x in kept.collect()) == [0, 1, 4, 5]
    for x in clean:
        assert sorted(r.doc_id for r in x.collect()) == [1, 2, 4, 5]
    assert {x.doc_id: x.text for x in lines.collect()}[5] == "other"


def test_empty_tables(spark, table):
    none = table.limit(0)
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "two three four")], "item_id long, text string")
    for found in (mixing.take(none), decontaminate.keep_clean(none, bench), decontaminate.keep_clean(none, bench, 0), linededup.dedup_lines(none), quality.keep_good(none, labels)):
        assert found.columns == table.columns and found.collect() == []
    assert decontaminate.keep_clean(table, bench.limit(0)).count() == table.count()
    assert quality.keep_good(table, labels.limit(0)).count() == table.count()
