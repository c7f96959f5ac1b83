import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tickerloom.llm import kneser_ney as kn
from tickerloom.llm.queries import QUERIES


def plain_tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", lowered) if w] + ["</s>"]


class PlainModel:
    def __init__(self, texts):
        self.unigrams, self.bigrams = Counter(), Counter()
        for t in texts:
            found = plain_tokens(t)
            self.unigrams.update(found)
            self.bigrams.update(zip(["<s>", *found], found, strict=False))
        self.left = Counter(w for _, w in self.bigrams)
        self.d2 = self.discounts(self.bigrams.values())
        self.d1 = self.discounts(self.left.values())
        self.follow = defaultdict(lambda: [0, [0, 0, 0]])
        for (v, _), c in self.bigrams.items():
            self.follow[v][0] += c
            self.follow[v][1][min(c, 3) - 1] += 1
        self.size = len(self.unigrams)
        self.free = sum(self.d1[min(c, 3)] for c in self.left.values()) / max(len(self.bigrams), 1)

    @staticmethod
    def discounts(values):
        n = Counter(values)
        n1, n2, n3, n4 = (n[k] for k in (1, 2, 3, 4))
        if not min(n1, n2, n3, n4):
            return [0, 0.5, 1, 1.5]
        y = n1 / (n1 + 2 * n2)
        raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        return [0] + [min(max(d, 0.01), k) for d, k in zip(raw, (1, 2, 3), strict=True)]

    def low(self, w):
        total = len(self.bigrams)
        if not total:
            return 1 / (self.size + 1)
        c = self.left[w]
        return (c - self.d1[min(c, 3)]) / total + self.free / (self.size + 1)

    def p(self, v, w):
        total, kinds = self.follow[v] if v in self.follow else (0, [])
        if not total:
            return self.low(w)
        c = self.bigrams[v, w]
        free = sum(d * k for d, k in zip(self.d2[1:], kinds, strict=True)) / total
        return (c - self.d2[min(c, 3)]) / total + free * self.low(w)

    def score(self, text):
        found = plain_tokens(text)
        return sum(math.log10(self.p(v, w)) for v, w in zip(["<s>", *found], found, strict=False))


def test_query_against_brute_force(spark, sf_dir, both, monkeypatch):
    monkeypatch.setattr(kn, "table", lambda *_: both)
    rows = QUERIES["op9_kneser_ney"](spark, sf_dir).collect()
    given = both.collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    model = PlainModel(r.text for r in given if not held(r.doc_id))
    total = sum(model.unigrams.values())
    expected = []
    for r in given:
        found = plain_tokens(r.text)
        base = sum(
            math.log10((model.unigrams[t] + 0.5) / (total + 0.5 * (model.size + 1))) for t in found
        )
        known = sum(model.unigrams[t] > 0 for t in found)
        expected.append((str(r.doc_id), held(r.doc_id), len(found), known, total, base, model.score(r.text)))
    found = [
        (str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
        for r in rows
    ]
    assert len(found) == len(expected)
    for a, b in zip(sorted(found), sorted(expected), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_probabilities_of_a_context_sum_to_one(spark, docs):
    model = kn.train(docs.limit(60))
    mapped = kn.Mapped(model)
    hashes = np.concatenate(
        [mapped.array("hash", s) for s in range(model.shards) if model.size(s)] + [np.array([7], np.uint64)]
    )
    for context in (b"the", b"never-seen-in-training"):
        h = np.uint64(kn.xxhash.xxh64_intdigest(context))
        pairs = np.stack([np.full(len(hashes), h), hashes], axis=1).ravel()
        _, chance = kn.token_scores(mapped, pairs, np.full(len(hashes), 2))
        assert np.sum(10.0 ** chance[1::2]) == pytest.approx(1, abs=1e-9)


def test_nothing_to_learn_from(spark, no_docs, odd_docs):
    assert kn.score(no_docs, kn.train(no_docs), ["doc_id"]).count() == 0
    rows = kn.score(odd_docs, kn.train(no_docs), ["doc_id", "fingerprint"]).collect()
    assert len(rows) == odd_docs.count() and all(r.score == 0 and r.n_known == 0 for r in rows)
