import pytest

from loomwork.operators.engine import Engine, Query
from loomwork.plans.ir import PlanError
from loomwork.plans.record import wq
from loomwork.sources.snapshots import snapshots


def test_paginate_is_refused_aloud(spark):
    pages = [("http://s/", "<a href='http://s/?page=2'>x</a><p>1</p>"), ("http://s/?page=2", "<p>2</p>")]
    engine = Engine(spark, snapshots(spark.createDataFrame(pages, "url string, html string")))
    with pytest.raises(PlanError):
        engine.rows(Query.of(wq.reference("http://s/").resolve(paginate="page").select_all("p").text()))
    nested = wq.doc.select_all("a").extract(d=wq.doc.attr("href").resolve(paginate="page").select("p").text())
    with pytest.raises(PlanError):
        engine.rows(Query.of(nested))
    got = engine.rows(Query.of(wq.reference("http://s/").resolve(profile="basic").select_all("p").text())).collect()
    assert [x.value for x in got] == ["1"]
