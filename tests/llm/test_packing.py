import random
import time

import numpy as np
from pyspark.sql import functions as F
from test_count_tree import plain_components, plain_set

from tickerloom.llm import packing


def plain_pack(lengths, sources, clusters, capacity):
    """Best fit by looking at every bin; of equal residuals the bin that got there last."""
    bins, out, clock = [], [], 0
    for length, s, c in zip(lengths, sources, clusters, strict=True):
        fits = [b for b in bins if b[0] >= length and s not in b[1] and c not in b[2]]
        if fits:
            best = min(fits, key=lambda b: (b[0], -b[3]))
        else:
            best = [capacity, set(), set(), 0, len(bins)]
            bins.append(best)
        clock += 1
        best[0] -= length
        best[1].add(s)
        best[2].add(c)
        best[3] = clock
        out.append(best[4])
    return out


def test_against_looking_at_every_bin():
    rng = random.Random(4)
    for _ in range(30):
        n = rng.randint(0, 200)
        lengths = sorted((rng.randint(0, 60) for _ in range(n)), reverse=True)
        sources = [rng.choice([0, 0, 0, 1, 2, 3, 4]) for _ in range(n)]
        clusters = [rng.randint(0, 150) for _ in range(n)]
        got = packing.pack(np.array(lengths, int), np.array(sources, int), np.array(clusters, int), 64)
        assert got.tolist() == plain_pack(lengths, sources, clusters, 64)


def words_of(text):
    return len((text or "").encode().split())


def test_every_word_is_packed_once_and_no_bin_has_a_conflict(both):
    rows = packing.packed(both, capacity=300, shard_words=20_000).collect()
    given = both.collect()
    by_doc, bins = {}, {}
    for r in rows:
        by_doc.setdefault(str(r.doc_id), []).append(r)
        bins.setdefault(r.bin_id, []).append(r)
    want = {}
    for r in given:
        want.setdefault(str(r.doc_id), []).append(words_of(r.text))
    assert by_doc.keys() == want.keys()
    for i, lengths in want.items():
        assert sum(r.length for r in by_doc[i]) == sum(lengths)
        assert all(0 <= r.length <= 300 for r in by_doc[i])
    assert len({r.bin_id.split(":")[0] for r in rows}) > 1
    source = {r.doc_id: r.source for r in given if r.doc_id is not None and r.doc_id != 900016}
    for found in bins.values():
        assert sum(r.length for r in found) == found[0].bin_words <= 300
        assert len(found) == found[0].bin_pieces
        known = [source[r.doc_id] for r in found if r.doc_id in source]
        assert len(known) == len(set(known))


def test_duplicates_never_share_a_bin(spark):
    rows = [(i, "Same  words", f"s{i}") for i in range(40)] + [(99, "same words", "t")] * 3
    frame = spark.createDataFrame(rows, "doc_id int, text string, source string")
    found = packing.packed(frame).collect()
    assert len(found) == 43 and {r.bin_pieces for r in found} == {1}


def test_empty_table(no_docs):
    assert packing.packed(no_docs).count() == 0


def test_edited_copies_never_share_a_bin(spark):
    rng = random.Random(6)
    said = [f"w{rng.randint(0, 5000)}" for _ in range(120)]
    rows = [(0, " ".join(said), "s0"), (1, " ".join([*said, "more"]), "s1")]
    for i in range(2, 12):
        edited = list(said)
        edited[rng.randrange(len(said))] = f"new{i}"
        rows.append((i, " ".join(edited), f"s{i}"))
    rows += [(i, " ".join(f"x{rng.randint(0, 5000)}" for _ in range(120)), f"s{i}") for i in range(12, 24)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, source string")
    bins = {}
    for r in packing.packed(frame, capacity=1000).collect():
        bins.setdefault(r.bin_id, []).append(r.doc_id)
    assert sorted(i for found in bins.values() for i in found) == list(range(24))
    assert max(sum(i < 12 for i in found) for found in bins.values()) == 1
    assert len(bins) == 12


def test_many_copies_are_packed_in_time():
    """Empty texts, near copies and ordinary pieces, as many as a shard may hold."""
    began = time.process_time()
    n = 80_000
    found = packing.pack(np.zeros(n, int), np.arange(n), np.zeros(n, int), 2048)
    assert sorted(found.tolist()) == list(range(n))
    rng = random.Random(8)
    lengths = np.array(sorted((rng.randint(0, 120) for _ in range(n)), reverse=True))
    found = packing.pack(lengths, np.arange(n), np.array([rng.choice([0, 0, 1, k]) for k in range(n)]), 2048)
    assert len(found) == n and time.process_time() - began < 60


def test_clusters_against_all_pairs(spark):
    """Copies with few and with many edits, pages of one template, short texts."""
    rng = random.Random(12)
    texts = []
    for size in (6, 30, 120, 400):
        said = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(25):
            edited = list(said)
            for _ in range(rng.randint(0, size // 15)):
                edited[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(edited))
    frame = " ".join(f"t{i}" for i in range(60))
    texts += [frame + " " + " ".join(f"p{rng.randrange(10**6)}" for _ in range(65)) for _ in range(200)]
    texts += ["", "one two", "ONE  two", "one two three"]
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    rows = docs.select("doc_id", F.xxhash64("source").alias("source"), "text")
    schema = "doc_id bigint, source bigint, words bigint, cluster bigint, size bigint, buckets array<bigint>, point binary"
    described = rows.mapInArrow(packing._described, schema)
    near = {r.cluster: r.near for r in packing.near_clusters(docs.select("text"), described).collect()}
    of = {r.doc_id: near.get(r.cluster, r.cluster) for r in described.collect()}
    want = plain_components([(i, plain_set(t)) for i, t in enumerate(texts)])
    groups = lambda d: sorted(sorted(i for i in d if d[i] == g) for g in set(d.values()))
    assert groups(of) == groups(want)
    bins = packing.packed(docs.where("text like 't0 %'"), capacity=2048).select("bin_id").distinct().count()
    assert bins == -(-200 * 125 // 2000)
