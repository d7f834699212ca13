"""Pages by continuation keys, a growing dictionary, and a session without a named folder."""

import concurrent.futures
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tidemark.functions.tags import tag_hash
from tidemark.operators.paging import By, after, walked
from tidemark.sources.dictionary import Dictionary

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("nulls_first", [None, False, True])
def test_pages_with_ties_and_nulls(spark, descending, nulls_first):
    rows = spark.range(60).select("id", F.when(F.col("id") % 4 == 0, None).otherwise(F.col("id") % 5).alias("a"), F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 2).cast("double").alias("b")).cache()
    order = [By("a", descending, nulls_first), By("b", not descending, nulls_first), By("id")]
    want = [r.id for r in rows.orderBy(*(o.order() for o in order)).collect()]
    got, last = [], None
    while page := after(rows, order, 7, last).collect():
        got += [r.id for r in page]
        last = page[-1]
    assert got == want
    assert [r.id for r in walked(rows, order, 7, 3).collect()] == want[21:28] and walked(rows, order, 7, 9).isEmpty()


def test_deep_pages_cost_as_the_first(spark, tmp_path):
    """No offset in the plan, and the key reaches the scan."""
    spark.range(1000).select("id", (F.col("id") / 3).alias("v")).write.parquet(str(tmp_path / "t"))
    plan = after(spark.read.parquet(str(tmp_path / "t")), [By("v"), By("id")], 10, {"v": 300.0, "id": 900})._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=10" in plan and "Offset" not in plan and "GreaterThan(v,300.0)" in plan


def pairs(spark, rows):
    return spark.createDataFrame(rows, "tag_key string, tag_value string")


def test_dictionary_grows_by_touched_buckets(spark, tmp_path):
    d = Dictionary(spark, str(tmp_path / "d"), 8)
    assert d.rows().isEmpty()
    first = [("k", str(i)) for i in range(50)] + [("k", "1"), ("a=b", None)]
    assert d.add(pairs(spark, first)) == 51 and d.add(pairs(spark, first)) == 0
    before = {(r.tag_key, r.tag_value): r.id for r in d.rows().collect()}
    files = set((tmp_path / "d").rglob("*.parquet"))
    assert Dictionary(spark, str(tmp_path / "d")).add(pairs(spark, [("k", "7"), ("new", "x")])) == 1
    new = set((tmp_path / "d").rglob("*.parquet")) - files
    assert files <= set((tmp_path / "d").rglob("*.parquet")) and len({f.parent.name for f in new}) == 1
    after_all = {(r.tag_key, r.tag_value): r.id for r in d.rows().collect()}
    assert {k: after_all[k] for k in before} == before and len(set(after_all.values())) == len(after_all) == 52 and min(after_all.values()) >= 1
    assert d.rows().where(~tag_hash(F.col("tag_key"), F.col("tag_value")).eqNullSafe(F.col("hash"))).isEmpty()


def test_dictionary_with_writers_at_once(spark, tmp_path):
    Dictionary(spark, str(tmp_path / "d"), 4).add(pairs(spark, [("k", "0")]))
    with concurrent.futures.ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: Dictionary(spark, str(tmp_path / "d")).add(pairs(spark, [("k", str(i)) for i in range(k, k + 20)])), (0, 5, 10, 15)))
    rows = Dictionary(spark, str(tmp_path / "d")).rows().collect()
    assert sorted(int(r.tag_value) for r in rows) == list(range(35)) and len({r.id for r in rows}) == 35


def test_session_without_a_named_folder(tmp_path):
    """Where no shared folder is named, a local session makes its own, once; elsewhere that is an error."""
    code = """
import os
from tidemark.session import session, shared_dir
s = session("bare", spark__master="local[1]", spark__ui__enabled="false")
assert s.conf.get("spark.checkpoint.dir", None) is None
a = shared_dir(s)
assert a == shared_dir(s) and s.sparkContext.applicationId in a, a
s.range(3).write.parquet(a + "/x")
assert s.read.parquet(a + "/x").count() == 3
print("fine"); os._exit(0)
"""
    env = os.environ | {"PYTHONPATH": ROOT, "SPARK_CONF_DIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=180, check=False)
    assert "fine" in done.stdout, done.stderr[-800:]
