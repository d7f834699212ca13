"""The pipeline against brute force, stage by stage."""

import os
import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from tidemark.llm import pii, queries
from tidemark.llm.common import staged

from .test_operators import check_packing, linked, normal

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = staged(stage(spark, docs, SF), name)
        if k < 4:
            assert docs.columns == columns
            got = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_rules":
            kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.ORACLES['op2_line_rules']}) WHERE kept").fetchall()}
            assert set(got) == kept and all(texts[i] == t for i, t in got.items())
        elif name == "exact_dedup":
            first = {}
            for i in sorted(texts):
                first.setdefault(normal(texts[i]), i)
            assert set(got) == set(first.values())
        elif name == "near_dedup":
            assert set(got) == {i for i, (_, c) in linked(texts.items()).items() if i == c}
        elif name == "pii":
            assert set(got) == set(texts)
            for i, t in got.items():
                base = pii.base_spans(texts[i])
                assert t == texts[i] or base or re.search("<(EMAIL|IP|CARD|PHONE|SECRET)>", t)
                assert not base or not {texts[i][a:b] for _, a, b in base} & set(t.split())
        else:
            from tidemark.llm.packing import Capacity

            check_packing(texts.items(), docs.collect(), Capacity())
        texts = got
    assert Counter(map(tuple, (r[:5] for r in corpus_pipeline.run(spark, SF).collect()))) == Counter(map(tuple, (r[:5] for r in docs.collect())))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).fetchdf()
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    key = lambda d: sorted(tuple(map(str, r)) for r in d[columns].values.tolist())
    assert key(got) == key(want)
