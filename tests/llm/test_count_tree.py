"""The Jaccard join against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import count_tree
from tickerloom.llm.bitmaps import among, bitmap


def plain_set(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", lowered) if w]
    if not words:
        return frozenset()
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def linked(a, b):
    common = len(a & b)
    return bool(a) and bool(b) and 100 * common >= 80 * (len(a) + len(b) - common)


def plain_components(rows):
    """Least id reachable, by comparing all pairs of rows (id, set)."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(rows):
        for j, b in rows[n + 1 :]:
            if 10 * min(len(a), len(b)) >= 8 * max(len(a), len(b)) and linked(a, b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: find(i) for i in root}


def test_query_against_brute_force(both):
    rows = [(r.doc_id, plain_set(r.text)) for r in both.collect()]
    found = count_tree.jaccard_join(both).collect()
    assert sorted((str(r.doc_id), r.n_shingles) for r in found) == sorted((str(i), len(s)) for i, s in rows)
    # an id with several texts has a test of its own
    want = plain_components([(i, s) for i, s in rows if i is not None and i != 900016])
    assert {r.doc_id: r.component_id for r in found if r.doc_id in want} == want
    assert len(set(want.values())) < len(want)


def copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block", [8, 2048])
def test_large_groups_and_common_passages(spark, block):
    """Near copies drifting from their base, chains, and a passage that most documents share."""
    rng = random.Random(5)
    passage = " ".join(f"law{i}" for i in range(60))
    texts = []
    for size in (12, 60, 200):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        texts += copies(rng, base, 60, size // 20)
    chain = [f"c{i}" for i in range(80)]
    for i in range(40):
        chain = [f"c{80 + i}" if k == i else w for k, w in enumerate(chain)]
        texts.append(" ".join(chain))
    texts += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randint(5, 40))) for _ in range(150)]
    rng.shuffle(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r.component_id for r in count_tree.jaccard_join(frame, block=block).collect()}
    assert found == plain_components([(i, plain_set(t)) for i, t in enumerate(texts)])


def test_ids_with_several_texts_connect_them(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(9, b), (5, b), (5, a), (3, a), (7, None), (None, a), (None, "alone " * 9), (6, a + " end"), (6, a + " end")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted((str(r.doc_id), str(r.component_id)) for r in count_tree.jaccard_join(frame).collect())
    want = [(3, 3), (5, 3), (5, 3), (6, 3), (6, 3), (7, 7), (9, 3), (None, None), (None, 3)]
    assert found == sorted((str(i), str(c)) for i, c in want)


def test_bound_of_a_node_holds_for_all_below():
    rng = np.random.default_rng(3)
    points = rng.poisson(2.0, (500, 128)).astype(np.int32)
    points[250:] = points[:250] + rng.integers(0, 2, (250, 128)) * (rng.random((250, 1)) < 0.5)
    sizes = points.sum(axis=1).astype(np.int64)
    tree = count_tree.Tree(points, sizes)
    everything = np.ones(500, bool)
    for i in range(0, 500, 7):
        common = np.minimum(points, points[i]).sum(axis=1)
        assert sorted(tree.search(i, everything)) == np.flatnonzero(9 * common >= 4 * (sizes + sizes[i])).tolist()


def test_bound_holds_between_points_of_different_size():
    rng = np.random.default_rng(5)
    for size in (3, 100, 127, 128, 129, 511, 512, 4000):
        whole = np.unique(rng.integers(1 << 63, size=size, dtype=np.uint64))
        for kept in (size, -(-size * 9 // 10), size - 1):
            part = whole[:kept]
            a, b = (count_tree._points([count_tree.point(x).tobytes()])[0] for x in (whole, part))
            groups = min(len(a), len(b))
            assert max(len(a), len(b)) <= 2 * groups
            assert np.minimum(count_tree.folded(a, groups), count_tree.folded(b, groups)).sum() >= kept


def test_long_sets_that_share_half_are_not_taken_for_near():
    rng = np.random.default_rng(6)
    common = rng.integers(1 << 63, size=800, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(1 << 63, size=800, dtype=np.uint64)])) for _ in range(40)]
    points = count_tree._points([count_tree.point(x).tobytes() for x in sets])
    assert count_tree.forest(points, np.array([len(x) for x in sets]), None) == ([], [])


def test_bitmap_has_all(spark):
    frame = spark.range(1000).select(F.xxhash64("id").alias("h"))
    bits = bitmap(frame)
    hashes = np.array([r.h for r in frame.collect()], np.int64).view(np.uint64)
    assert among(bits, hashes).all() and len(bits) == 1 << 10
    assert not bitmap(frame.where("false")).any()


def test_empty_table_and_clashing_columns(no_docs, odd_docs):
    assert count_tree.jaccard_join(no_docs).count() == 0
    named = odd_docs.withColumns({c: F.lit("x") for c in ("key", "size", "g", "salt", "component", "point", "prefix")})
    assert count_tree.jaccard_join(named).count() == odd_docs.count()
