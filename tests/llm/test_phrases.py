"""Collocations against brute force and DuckDB."""

import re
from collections import Counter

import compare
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import phrases
from tickerloom.llm.hashing import Powers


def pieces(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for piece in re.split("[.,;:!?\n-\r]", lowered):
        if said := [w for w in re.split("[ \t]+", piece) if w]:
            yield said


def plain_phrases(rows, least=10, top=2000):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        for said in pieces(text):
            totals[lang] += len(said)
            for k in (1, 2, 3):
                f.update(tuple(said[i : i + k]) for i in range(len(said) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            longer = [f.get(q, 0) for q in candidates if len(q) > len(p) and p in (q[:2], q[1:])]
            if any(100 * x >= 50 * a for x in longer):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def test_query_against_brute_force_and_duckdb(spark, sf_dir, docs):
    rows = [(r.lang, r.text) for r in docs.collect()]
    query = phrases.op11_prefix_free_phrases(spark, sf_dir)
    mine = sorted(tuple(r) for r in query.collect())
    assert mine == plain_phrases(rows) and len({r[0] for r in mine}) > 1
    columns, _, theirs = compare.oracle_rows(compare.connect(sf_dir), phrases.ORACLE_OP11)
    assert columns == query.columns and mine == sorted(theirs)


@pytest.mark.parametrize("period", [1, 2, 7, 1 << 40])
def test_any_period_counts_alike(both, period):
    rows = [(r.lang, r.text) for r in both.collect()]
    found = phrases.collocations(both, least=3, top=50, period=period)
    assert sorted(tuple(r) for r in found.collect()) == plain_phrases(rows, 3, 50)


def test_chunks_overlap_by_their_trigger_and_give_back_the_text():
    text = b"A b  c\td e f g h i j k l , m n o. p;; q r s t u v w x y z a b c d e f g"
    chunks, of = phrases.parse([b"", text, b" . ", b"one", text], Powers(), 3)
    assert set(of.tolist()) == {1, 3, 4}
    said, joined, opened = {}, False, 0
    for chunk, i in zip(chunks.to_pylist(), of.tolist(), strict=True):
        words = chunk[:-1].split(" ")
        if joined:
            assert said[i][-1][-2:] == words[:2]
            said[i][-1] += words[2:]
        else:
            said.setdefault(i, []).append(words)
        joined = chunk[-1] == chr(phrases.OPEN)
        opened += joined
    want = [w for x in re.split("[.,;]", text.decode().lower()) if (w := x.split())]
    assert said == {1: want, 3: [["one"]], 4: want} and opened


def test_counts_beyond_64_bits(spark):
    rows = [("en", "x y\n", 3_000_000_000), ("en", "z x\n", 1), ("en", "y z\n", 5)]
    chunks = spark.createDataFrame(rows, "lang string, chunk string, n bigint")
    grams = phrases.frequent_ngrams(chunks)
    assert {(r.phrase, r.n) for r in grams.collect()} == {("x", 3_000_000_001), ("y", 3_000_000_005), ("x y", 3_000_000_000)}


def test_empty_table_clashing_columns_and_long_text(spark, no_docs, odd_docs):
    assert phrases.collocations(no_docs).count() == 0
    named = odd_docs.withColumns({c: F.lit("x") for c in ("chunk", "n", "phrase", "size", "score", "a", "l", "r", "k")})
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    assert sorted(tuple(r) for r in phrases.collocations(named).collect()) == plain_phrases(rows)
    long = spark.createDataFrame([("en", "one two three " * 400_000), ("en", "same " * 900_000)], "lang string, text string")
    assert sorted(tuple(r) for r in phrases.collocations(long).collect()) == plain_phrases([tuple(r) for r in long.collect()])
