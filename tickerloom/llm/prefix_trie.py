"""Prefix trie of conversations, with subtree totals by time-forward processing.

Every distinct sequence of the first d turns of the rebuilt conversations is a node. A node is
known by a running hash of its turns, so that texts are hashed where they are read and are never
moved: ``sum(turn_hash * BASE ** place) mod PRIME``. Long conversations are cut into segments of
``SEGMENT`` turns which are summed apart, and the sums before a segment are added to it.

Totals go up the trie in time-forward processing. Nodes are sorted in reverse level order, deepest
first; every node takes from a priority queue what its children sent and sends its own totals to
its parent, whose turn comes later. A shard is a largest subtree of at most ``SHARD``
conversations. It is streamed in sorted order, as the shuffle left it, spilled where it was too
large. Nodes of one depth have no conversation in common, so that the queue holds ``SHARD`` messages
at most. What the roots of shards send is summed by receiver, and the nodes above form the next,
``SHARD`` times smaller trie, up to the root of all. Nodes of a single conversation need no messages:
below them is one path with one leaf and nothing shared.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import crc_fold, numbered, stored, table, words

PRIME = (1 << 127) - 1
BASE = 0x3C6EF372FE94F82BA54FF53A5F1D36F1
#: Turns that are summed at once, conversations of a shard, and ids of a chunk that is hashed.
SEGMENT = 4096
SHARD = 4096
CHUNK = 4096
ROOT = bytes(16)
#: Conversations that share an opening, and the most turns of it.
BROOD = 20
OPENING = 4


def _label(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All ``conv_id`` and the rows ``(conv_id, d, label, size)`` of the rebuilt conversations."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        _label(role, text).alias("label"),
        F.size(words(text)).cast("bigint").alias("size"),
    )
    placed = stored(numbered(rows, "conv_id", ["turn", "label"]), "places")
    wants = crc_fold(F.col("conv_id"), OPENING).cast("bigint")
    given = placed.where(F.col("place") < OPENING - 1).select(
        F.col("conv_id").alias("giver"), "place", F.col("label").alias("given"), F.col("size").alias("given_size")
    )
    have = given.groupBy("giver").agg(F.count("*").alias("have"))
    convs = placed.select("conv_id").distinct().withColumn("h", wants)
    convs = convs.withColumn("giver", F.col("conv_id") - F.col("conv_id") % BROOD)
    convs = stored(convs.join(have, "giver", "left").withColumn("taken", F.least("h", F.coalesce("have", F.lit(0)))), "convs")
    opening = convs.join(given, "giver").where("place < h").select(
        "conv_id", (F.col("place") + 1).alias("d"), F.col("given").alias("label"), F.col("given_size").alias("size")
    )
    own = placed.join(convs.select("conv_id", "h", "taken"), "conv_id").where("place >= h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken") + 1).alias("d"), "label", "size")
    return convs.select("conv_id"), opening.unionByName(own)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running sums in sorted rows (conv_id, segment, d, label, size), from each segment's start."""
    at, total, power = None, 0, 0
    for batch in batches:
        conv, segment, place, label, size = (c.to_pylist() for c in batch.columns)
        keys, parents = [], []
        for c, s, d, x in zip(conv, segment, place, label, strict=True):
            if at != (c, s):
                at, total, power = (c, s), 0, pow(BASE, d, PRIME)
            parents.append(total.to_bytes(16))
            total = (total + int.from_bytes(x) * power) % PRIME
            power = power * BASE % PRIME
            keys.append(total.to_bytes(16))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(keys, pa.binary()), pa.array(parents, pa.binary()), batch.column(4)],
            names=["conv_id", "segment", "d", "key", "parent", "size"],
        )


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted rows (conv_id, segment, key) of whole segments: the sum before each."""
    at, total = None, 0
    for batch in batches:
        before = []
        for c, key in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if c != at:
                at, total = c, 0
            before.append(total.to_bytes(16))
            total = (total + int.from_bytes(key)) % PRIME
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(before, pa.binary())], names=["conv_id", "segment", "before"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pydict()
        before = [int.from_bytes(x) for x in rows["before"]]
        put = lambda name: pa.array(
            [((int.from_bytes(x) + b) % PRIME).to_bytes(16) for x, b in zip(rows[name], before, strict=True)], pa.binary()
        )
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("d"), put("key"), put("parent"), batch.column("size")],
            names=["conv_id", "d", "key", "parent", "size"],
        )


def chains(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``(conv_id, d, key, parent, size)``: the node of every turn of ``rebuilt`` rows."""
    cut = rows.withColumn("segment", F.floor((F.col("d") - 1) / segment).cast("bigint"))
    cut = cut.select("conv_id", "segment", "d", "label", "size").repartition("conv_id", "segment")
    schema = "conv_id bigint, segment bigint, d bigint, key binary, parent binary, size bigint"
    summed = stored(cut.sortWithinPartitions("conv_id", "segment", "d").mapInArrow(_summed, schema), "sums")
    same = ["conv_id", "d", "key", "parent", "size"]
    long = summed.where("segment > 0")
    ends = summed.where(F.col("d") % segment == 0).select("conv_id", "segment", "key")
    last = long.groupBy("conv_id", "segment").agg(F.max_by("key", "d").alias("key"))
    whole = ends.unionByName(last).groupBy("conv_id", "segment").agg(F.first("key").alias("key"))
    carried = whole.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(
        _carried, "conv_id bigint, segment bigint, before binary"
    )
    moved = long.join(carried, ["conv_id", "segment"]).mapInArrow(
        _added, "conv_id bigint, d bigint, key binary, parent binary, size bigint"
    )
    return summed.where("segment = 0").select(*same).unionByName(moved.select(*same))


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Totals of sorted rows (top, depth, key, parent, own, leaves, saved, n_children), deepest first."""
    waiting: list[tuple[int, bytes, int, int]] = []
    for batch in batches:
        tops, depths, keys, parents, owns, leaves, saved, children = (c.to_pylist() for c in batch.columns)
        out_leaves, out_saved = [], []
        for top, depth, key, parent, own, n, s, c in zip(tops, depths, keys, parents, owns, leaves, saved, children, strict=True):
            s += own
            while waiting and waiting[0][0] == -depth and waiting[0][1] == key:
                _, _, more, sum_ = heapq.heappop(waiting)
                n, s = n + more, s + sum_
            n = n if c else 1
            if key != top:
                heapq.heappush(waiting, (1 - depth, parent, n, s))
            out_leaves.append(n)
            out_saved.append(s)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), batch.column(3), pa.array(out_leaves, pa.int64()), pa.array(out_saved, pa.int64())],
            names=["top", "key", "parent", "n_leaves", "saved_tokens"],
        )


def totals(nodes: DataFrame, chain: DataFrame, n_all: int, shard: int = SHARD) -> DataFrame:
    """``(key, n_leaves, saved_tokens)`` of nodes with several conversations, and of the root.

    ``nodes`` have key, parent, conv_id, depth, n_convs, own, n_children and singles, the number
    of children with a single conversation.
    """
    sums = "top binary, key binary, parent binary, n_leaves bigint, saved_tokens bigint"
    sent = nodes.select("key", F.col("singles").alias("leaves"), F.lit(0).cast("bigint").alias("saved")).where("leaves > 0")
    done: DataFrame | None = None
    above, most = 1, shard
    while True:
        here = nodes.where((F.col("n_convs") > above) | (F.col("depth") == 0))
        if n_all <= most:
            here = here.withColumn("top", F.lit(ROOT))
        else:
            here = here.where((F.col("n_convs") <= most) & (F.col("depth") > 0))
            held = chain.select("conv_id", "d", "key").join(here.select("key"), "key")
            tops = held.groupBy("conv_id").agg(F.min_by("key", "d").alias("top"))
            here = here.join(tops, "conv_id")
        got = sent.groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        zero = F.lit(0).cast("bigint")
        rows = here.join(got, "key", "left").select(
            "top", "depth", "key", "parent", "own",
            F.coalesce("leaves", zero).alias("leaves"), F.coalesce("saved", zero).alias("saved"), "n_children",
        )
        sorted_ = rows.repartition("top").sortWithinPartitions("top", F.col("depth").desc(), "key")
        found = stored(sorted_.mapInArrow(_forward, sums), "totals")
        done = found if done is None else done.unionByName(found)
        if n_all <= most:
            return done.select("key", "n_leaves", "saved_tokens")
        tops = found.where("key = top").select(
            F.col("parent").alias("key"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")
        )
        sent = sent.unionByName(tops)
        above, most = most, most * shard


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of comma-joined ids from sorted rows (key, conv_id)."""
    for batch in batches:
        keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out, at = [], 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[at] or i - at == CHUNK:
                out.append((keys[at], ids[at], ",".join(map(str, ids[at:i]))))
                at = i
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)],
            names=["key", "first", "ids"],
        )


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each key of sorted chunks (key, first, ids)."""
    at, digest = None, None
    for batch in batches:
        keys, hashes = [], []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key != at:
                if digest is not None:
                    keys.append(at)
                    hashes.append(digest.hexdigest())
                at, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], names=["key", "ends_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """``(key, ends_sha256)`` of ``ends(key, conv_id)``.

    Ids are sorted and joined into chunks over all tasks; what one task does for a key is to run
    its chunks through the hash, which cannot be split, in their order and without holding them.
    """
    spread = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    chunks = spread.mapInArrow(_joined, "key binary, first bigint, ids string")
    chunks = chunks.repartition("key").sortWithinPartitions("key", "first")
    return chunks.mapInArrow(_digested, "key binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, shard: int = SHARD, segment: int = SEGMENT) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, the root included.

    ``turns`` has conv_id, turn, role and text. Turns are ordered by number, NULL first, equal
    numbers by the MD5 of role and text; repeated rows are turns of their own. NULL roles and
    texts are empty. Rows without a conversation are left out, an empty table has no node. Texts
    are hashed whole, at any length. Other columns are not read.
    """
    convs, rows = rebuilt(turns)
    chain = stored(chains(rows, segment), "chain")
    zero = F.lit(0).cast("bigint")
    convs = stored(convs, "ids")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(
        F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), "conv_id", zero.alias("depth"), "n_convs", zero.alias("size")
    )
    below = chain.groupBy("key").agg(
        F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.first("d").alias("depth"),
        F.count("*").alias("n_convs"), F.first("size").alias("size"),
    )
    nodes = stored(below.unionByName(root), "nodes")
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(
        F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("singles")
    )
    nodes = nodes.join(kids, "key", "left").withColumns(
        {"n_children": F.coalesce("n_children", zero), "singles": F.coalesce("singles", zero)}
    )
    nodes = stored(nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("size")), "children")
    found = totals(nodes, chain, nodes.agg(F.max("n_convs")).first()[0] or 0, shard)
    last = chain.groupBy("conv_id").agg(F.max_by("key", "d").alias("key"))
    ends = convs.join(last, "conv_id", "left").select(F.coalesce("key", F.lit(ROOT)).alias("key"), "conv_id")
    parents = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    one = (F.col("n_convs") == 1) & (F.col("depth") > 0)
    return (
        nodes.join(found, "key", "left")
        .join(parents, "parent", "left")
        .join(end_hashes(ends), "key", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
            F.when(one, F.lit(1).cast("bigint")).otherwise(F.col("n_leaves")).alias("n_leaves"),
            F.when(one, zero).otherwise(F.col("saved_tokens")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )


def op13_time_forward_trie(spark, sf_dir):
    """Every node of the prefix trie of the rebuilt conversations, with its subtree's totals."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


ORACLE_OP13 = r"""
WITH RECURSIVE turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) - 1 AS place,
         md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS label,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS size
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS giver,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
               lambda ch: CAST(ord(ch) AS BIGINT))),
             lambda x, y: list_reduce(list_concat([xor(x, y)], [0, 0, 0, 0, 0, 0, 0, 0]),
               lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)),
             4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
parts AS (
  SELECT c.conv_id, 0 AS side, t.place, t.label, t.size FROM convs c JOIN turns t ON t.conv_id = c.giver WHERE t.place < c.h
  UNION ALL
  SELECT c.conv_id, 1, t.place, t.label, t.size FROM convs c JOIN turns t ON t.conv_id = c.conv_id WHERE t.place >= c.h),
built AS (
  SELECT conv_id, label, size, row_number() OVER (PARTITION BY conv_id ORDER BY side, place) AS d FROM parts),
chain AS (
  SELECT conv_id, d, size, string_agg(label, '') OVER (PARTITION BY conv_id ORDER BY d) AS key FROM built
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
ends AS (
  SELECT key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, arg_max(key, d) AS key FROM chain GROUP BY conv_id) GROUP BY key),
nodes AS (
  SELECT key, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
         CASE WHEN d > 0 THEN left(key, CAST(32 * (d - 1) AS BIGINT)) END AS parent
  FROM chain GROUP BY key, d),
kids AS (SELECT parent, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
full_nodes AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.parent = n.key),
above AS (
  SELECT left(n.key, CAST(32 * u.d AS BIGINT)) AS key, CAST(n.n_children = 0 AS BIGINT) AS leaf, (n.n_convs - 1) * n.size AS own
  FROM full_nodes n, LATERAL (SELECT unnest(range(0, n.depth + 1)) AS d) u),
sums AS (SELECT key, sum(leaf) AS n_leaves, sum(own) AS saved_tokens FROM above GROUP BY key)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens,
       coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM full_nodes n JOIN sums s ON s.key = n.key
LEFT JOIN nodes p ON p.key = n.parent AND p.depth = n.depth - 1
LEFT JOIN ends e ON e.key = n.key
"""
