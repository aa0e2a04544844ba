import random

from pyspark.sql import functions as F

from loomwork.functions import columns as N
from loomwork.functions import values
from loomwork.queries import QUERIES


def test_a_text_is_made_once(spark, tmp_path):
    """However many groups are read from it."""
    spark.sql("select 1L as event_id, timestamp'2024-03-09 10:00:00' as ts").write.parquet(f"{tmp_path}/events.parquet")
    df = QUERIES["fn_date"](spark, str(tmp_path))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("date_format(") == 6  # three texts, three results
    assert [tuple(x) for x in df.collect()] == [(1, *["2024-03-09"] * 3)]


def test_dates_in_odd_texts(spark):
    known = {"2024-13-45 or 3 Mar 2024": "2024-03-03", "31 Feb 2026, May 5 2020": "2020-05-05", "1/2/99": "2099-01-02", "13/2/2024": "2024-02-13", "99/99/9999 x 1.2.2003": None, "1/2/20245": None, "Sept. 9th, 1999": "1999-09-09", "": None}
    r, months = random.Random(3), "Jan Feb. march APRIL may Sept december".split()
    made = [r.choice([f"{d}/{m}/{y}", f"{y}.{m}.{d}", f"on {d}th {r.choice(months)} {y}", f"{r.choice(months)} {d}, {y}", f"{y}-{m:02}-{d:02}"]) for d, m, y in ((r.randint(1, 28), r.randint(1, 12), r.randint(1900, 2100)) for _ in range(200))]
    df = spark.createDataFrame([(t,) for t in [*known, *made, None]], "t string")
    got = {x.t: (x.a, x.b) for x in df.select("t", N.date(F.col("t")).alias("a"), N.date(F.col("t"), dayfirst=True).alias("b")).collect()}
    assert {t: got[t][0] for t in known} == known and got[None] == (None, None)
    assert all(got[t] == (values.date(t), values.date(t, dayfirst=True)) for t in made)
