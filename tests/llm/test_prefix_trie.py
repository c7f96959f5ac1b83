"""The prefix trie against brute force and DuckDB."""

import hashlib
import math
import random
import re
import zlib

import compare
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import prefix_trie as trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def order(row):
    _, turn, role, text = row
    label = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
    return (turn is not None, turn or 0, label)


def plain_trie(rows):
    convs = {}
    for row in rows:
        if row[0] is not None:
            convs.setdefault(row[0], []).append(row)
    turns = {c: [(r[2] or "", r[3] or "") for r in sorted(found, key=order)] for c, found in convs.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(turns.get(c - int(math.fmod(c, 20)), [])[:h] + turns[c][h:])
    members = {}
    for c, said in built.items():
        for d in range(len(said) + 1):
            members.setdefault(said[:d], []).append(c)
    children, leaves, saved = ({} for _ in range(3))
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len([w for w in re.split("[\x20\x09-\x0d]+", node[-1][1]) if w]) if node else 0
        saved[node] = saved.get(node, 0) + own
        leaves[node] = leaves.get(node, 0) if node in children else 1
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
            leaves[node[:-1]] = leaves.get(node[:-1], 0) + leaves[node]
            saved[node[:-1]] = saved.get(node[:-1], 0) + saved[node]
    out = []
    for node, held in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in held if len(built[c]) == len(node)))
        out.append((
            min(held), len(node), min(members[node[:-1]]) if node else None, len(held), children.get(node, 0),
            leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def found(frame, **kwargs):
    return sorted((tuple(r) for r in trie.prefix_trie(frame, **kwargs).collect()), key=str)


def test_query_against_brute_force_and_duckdb(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    query = trie.op13_time_forward_trie(spark, sf_dir)
    assert sorted((tuple(r) for r in query.collect()), key=str) == plain_trie(rows)
    columns, _, theirs = compare.oracle_rows(compare.connect(sf_dir), trie.ORACLE_OP13)
    mine = [[str(x) for x in r] for r in query.select(*columns).collect()]
    assert sorted(mine) == sorted([str(x) for x in r] for r in theirs)


@pytest.mark.parametrize(("shard", "segment"), [(2, 4), (3, 1), (4096, 4096)])
def test_shards_and_segments_change_nothing(spark, shard, segment):
    """Shared openings, copies, long dialogues, gaps, ties, NULLs and repeated rows."""
    rng = random.Random(11)
    said = ["hello there", "how are you  today", "", None, "fine", "a b c d e"]
    rows = []
    for c in [*range(0, 120), 400, 401, 7000]:
        n = rng.choice([0, 1, 2, 3, 5, 40]) if c % 20 else rng.choice([2, 5])
        for t in range(n):
            same = rng.random() < 0.8
            rows.append((c, t * 3, ["user", "assistant", None][t % 3], said[t % 6] if same else rng.choice(said) or f"x{rng.random()}"))
    rows += [(400, None, "user", "first"), (400, None, "system", "first"), (400, 1, "user", "twice"), (400, 1, "user", "twice")]
    rows += [(None, 0, "user", "nobody's"), (1041, 0, "user", "its giver is absent"), (-3, 0, "user", "below zero")]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(frame, shard=shard, segment=segment) == plain_trie(rows)


def test_whole_copies_share_one_end(spark):
    rows = [(20 * c, t, "user", f"turn {t}") for c in range(300) for t in range(4)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(frame, shard=16) == plain_trie(rows)


def test_empty_table_and_clashing_columns(spark):
    frame = spark.createDataFrame([(1, 0, "user", "x")], SCHEMA)
    assert trie.prefix_trie(frame.where("false")).count() == 0
    assert trie.prefix_trie(frame.where("false").union(frame.withColumn("conv_id", F.lit(None).cast("bigint")))).count() == 0
    named = frame.withColumns({c: F.lit("x") for c in ("key", "parent", "place", "d", "label", "size", "segment", "top")})
    assert found(named) == plain_trie([(1, 0, "user", "x")])
