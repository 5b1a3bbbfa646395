import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from pagemill.llm.op06_toxicity import fit, toxicity

from .test_near_copies import brute as near
from .test_op04_decontamination import brute as hits

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        stage(spark, docs, SMALL).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return [*out, docs]


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_columns_stay_to_the_last_stage(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns


def test_toxicity(spark, stages):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    want = {r["doc_id"] for r in toxicity(stages[0], labels).where("predicted = 0").collect()}
    assert ids(stages[1]) == want and fit(stages[0], labels) is not None


def test_exact_dedup(stages):
    best = {}
    for r in stages[1].collect():
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
    assert ids(stages[2]) == set(best.values())


def test_near_dedup(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    want, _ = near(rows)
    assert ids(stages[3]) == {d for d, least in want.items() if d == least}


def test_decontamination(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    found = hits([(r["doc_id"], r["text"]) for r in stages[3].collect()], items, 13)
    assert ids(stages[4]) == {d for d, n, hit, _ in found if not (sum(hit) and 20 * sum(hit) >= n)}


def test_packing_has_every_token(stages):
    pieces, tokens = defaultdict(int), {}
    for r in stages[5].collect():
        pieces[r["doc_id"]] += r["length"]
        tokens[r["doc_id"]] = r["doc_tokens"]
        assert len(np.frombuffer(r["ids"], "<u4")) == r["length"]
    assert set(pieces) == ids(stages[4]) and pieces == tokens


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == stages[5].columns and got.count() == stages[5].count()
    assert ids(got) == ids(stages[5])


def test_guard_is_in_the_entry_alone():
    assert not re.search("ImportError|ModuleNotFound", open(corpus_pipeline.__file__).read())
