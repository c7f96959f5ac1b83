import hashlib
import re
from collections import Counter

import pytest

from tickerloom.llm import weighted_prints as wp
from tickerloom.llm.queries import QUERIES


def bag(text):
    return Counter(w for w in re.split("[\x20\x09-\x0d]+", text) if w)


def jaccard(a, b):
    a, b = bag(a), bag(b)
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def in_order(rows):
    return sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0))


def test_query_against_brute_force(spark, sf_dir, docs, monkeypatch):
    odd = spark.createDataFrame(
        [(900001, None), (900002, ""), (900003, "one"), (900004, "é中 \U0001f600 x"), (900010, "w " * 3000)],
        "doc_id bigint, text string",
    )
    given = docs.select("doc_id", "text").union(odd)
    monkeypatch.setattr(wp, "table", lambda *_: given)
    found = in_order(QUERIES["op10_cws_fingerprints"](spark, sf_dir).collect())
    rows = in_order(given.collect())
    assert [r.doc_id for r in found] == [r.doc_id for r in rows]
    errors = []
    for i, (r, f) in enumerate(zip(rows, found, strict=True)):
        text, following = r.text or "", rows[(i + 1) % len(rows)].text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert f.n_chars == len(text)
        assert f.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [f.near_edited - jaccard(text, edited), f.near_next - jaccard(text, following)]
        if text == edited:
            assert f.fingerprint == f.edited_fingerprint and f.near_edited == 1
    # the share of equal samples estimates the generalised Jaccard similarity, without bias
    assert abs(sum(errors) / len(errors)) < 0.01
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.05
    same = {}
    for r, f in zip(rows, found, strict=True):
        assert same.setdefault(r.text or "", f.fingerprint) == f.fingerprint


def test_weights_count(spark):
    texts = ["a " * k + " ".join(f"w{i}" for i in range(2000)) + " b" * (200 - k) for k in (10, 150)]
    pairs = spark.createDataFrame([(texts[0], texts[1])], "a string, b string")
    got = wp.with_samples(pairs, {"x": "a", "y": "b"}).select(wp.likeness("x", "y")).first()[0]
    assert got == pytest.approx(jaccard(*texts), abs=0.1)


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_every_document_finds_the_next(spark, parts):
    ids = [5, 7, 7, 100, 2000, 2001, 90000, -3, None]
    given = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "doc_id bigint, text string")
    found = in_order(wp.compare_neighbours(given, parts).collect())
    assert len(found) == len(ids)
    texts = {-3: "t7", 5: "t0"}
    edited = {-3: "t" + "t", 5: "t" + "t"}
    for r in found[:2]:
        assert r.edited_sha256 == hashlib.sha256(edited[r.doc_id].encode()).hexdigest(), texts


def test_empty_tables_and_no_ids(spark, no_docs, odd_docs):
    assert wp.compare_neighbours(no_docs, 4).count() == 0
    nameless = odd_docs.where("doc_id is null")
    assert wp.compare_neighbours(nameless, 4).count() == 2
    assert wp.compare_neighbours(odd_docs, 4).count() == odd_docs.count()
