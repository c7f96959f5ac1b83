import random

import pytest

from tickerloom.llm import weak_labels as wl
from tickerloom.llm.queries import QUERIES


def test_em_finds_accuracies_of_planted_labellers():
    rng = random.Random(5)
    truth, patterns, planted = {}, {}, [0.9, 0.8, 0.7, 0.85, 0.75]
    for _ in range(20_000):
        good = rng.random() < 0.7
        cast = "".join(
            "-" if rng.random() < 0.3 else "g" if good == (rng.random() < a) else "b" for a in planted
        )
        patterns[cast] = patterns.get(cast, 0) + 1
        truth.setdefault(cast, []).append(good)
    posterior, accuracy, prior = wl.fit_labellers(patterns)
    assert accuracy == pytest.approx(planted, abs=0.03) and prior == pytest.approx(0.7, abs=0.03)
    for cast, goods in truth.items():
        if len(goods) > 300:
            assert posterior[cast] == pytest.approx(sum(goods) / len(goods), abs=0.08)


def test_query_against_the_labels(spark, sf_dir):
    path = sf_dir.replace("sf0.001", "sf0.01")
    rows = {r.doc_id: r for r in QUERIES["op7_weak_label_quality"](spark, path).collect()}
    labels = spark.read.parquet(f"{path}/labels.parquet").collect()
    good = [rows[r.doc_id].kept for r in labels if r.quality == 1]
    bad = [rows[r.doc_id].kept for r in labels if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_odd_rows(both, odd_docs, no_docs):
    rows = wl.classify(both).collect()
    assert len(rows) == both.count() and all(0 <= r.score <= 1 for r in rows)
    assert not {r.doc_id: r for r in rows}[900001].kept
    assert len({(r.votes, r.posterior, r.score) for r in rows if r.doc_id in (900007, 900008)}) == 1
    assert wl.classify(odd_docs).count() == odd_docs.count()
    assert wl.classify(no_docs).count() == 0
