import random
from collections import Counter
from math import log

import numpy as np
import pytest
from newsignal.llm import importance, near_dups, queries
from texts import prose


def test_kth_largest_is_exact(spark):
    rng = random.Random(3)
    values = [rng.gauss(0, 1) for _ in range(500)] + [2.5] * 40 + [1e12, -1e12]
    keys = spark.createDataFrame([(v,) for v in values] + [(None,)], "key double")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 30, 270, 541, 542, 9999):
        assert importance.kth_largest(keys, k) == ordered[min(k, len(ordered)) - 1]
    assert importance.kth_largest(keys.where("key is null"), 3) is None


def test_weights_equal_brute_force(spark, documents):
    rows = [(i, prose(i, 30 + i, 50)) for i in range(40)]
    found = importance.importance_sample(documents(rows), documents([(i,) for i in range(10)], "doc_id long"), 0.5)
    hashes = near_dups.WordHashes()
    feats = {i: importance.features(t.encode(), hashes).tolist() for i, t in rows}
    raw, aim = Counter(), Counter()
    for i, f in feats.items():
        raw.update(f)
        if i < 10:
            aim.update(f)
    size = 1 << importance.BITS

    def ratio(b):
        return log((aim[b] + 1) / (aim.total() + size)) - log((raw[b] + 1) / (raw.total() + size))

    got = found.collect()
    for r in got:
        assert r.log_weight == pytest.approx(sum(map(ratio, feats[r.doc_id])), abs=1e-9)
        assert r.n_features == len(feats[r.doc_id])
    best = sorted(got, key=lambda r: -r.key)[:20]
    assert {r.doc_id for r in got if r.sampled} == {r.doc_id for r in best}


def test_odd_rows(documents, odd_rows):
    ids = documents([(5,), (None,), (5,), (99,)], "doc_id long")
    found = importance.importance_sample(documents(odd_rows), ids, 0.5)
    assert found.count() == len(odd_rows)
    assert found.where("n_features = 0 and (sampled or log_weight is not null)").count() == 0
    assert importance.importance_sample(documents([]), ids, 0.5).count() == 0
    none = importance.importance_sample(documents(odd_rows), ids.where("doc_id < 0"), 1.0)
    assert {r.log_weight for r in none.where("n_features > 0").collect()} == {0.0}
    assert none.where("sampled").count() == none.where("n_features > 0").count()


def test_junk_is_left_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op4_importance_resampling(spark, sf).join(labels, "doc_id").collect()
    clean = [r.sampled for r in rows if r.quality == 1 and r.toxic == 0]
    junk = [r.sampled for r in rows if r.quality == 0]
    assert np.mean(clean) > 0.97 and np.mean(junk) < 0.3
