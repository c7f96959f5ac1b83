"""Jaccard join of shingle sets over R-trees of count vectors.

A document's set holds the 64-bit hashes of its distinct five-word shingles. Hashes fall into
groups by their last bits, two to four in a group, and the counts of the groups are a point. Two sets have at most the sum of the
coordinate minima of their points in common, and sets below a node of an R-tree at most the sum
of the minima with the node's upper corner. Sets link when ``100 * common >= 80 * union``, that is
``9 * common >= 4 * (size + size)``, so a subtree whose bound is below that is passed over.

The number of groups is a power of two that follows the size of the set, since a bound is only close
where few hashes share a group. Sets that link differ in size by a quarter at most, so their points
have equal numbers of groups or one has twice as many and is folded.

One tree over all points would meet most of its leaves for every point, since corners of unrelated
sets are high. So there are many trees: sets that link share one of the first
``size - ceil(0.8 * size) + 1`` hashes in any common order, and each such hash has a tree of the sets
that have it there. The order is that of the hashes, but with frequent ones last, which keeps
passages common to many documents from making large trees.

1. Points, prefixes in the order of hashes, and set keys are written once; equal sets share a key
   and are one point. Prefix hashes are counted over all documents, and sets with frequent ones get
   their prefix in the final order.
2. Of hashes that several sets have in their prefix, those with the same sets are one tree.
3. Each tree is searched by its points, and a spanning forest of the surviving pairs is kept. Its
   components, the classes, hold all links.
4. The texts of each class come together and their sets are built again. The class has a tree
   that proposes pairs, sets are compared exactly, and a forest of the links is kept; its components
   are the result.

Groups of more than ``BLOCK`` sets are dealt out to blocks, each with one set in common, the pivot;
then sets that are not connected to the pivot, in blocks of their own, meet all blocks. So a group of near copies
costs as much as its rows, and no pair is lost.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.bitmaps import among, bitmap
from tickerloom.llm.common import stored, table
from tickerloom.llm.components import connected_components
from tickerloom.llm.hashing import Powers, shingle_sets

WIDTH = 5
#: Hashes of a set for each group, and the fewest groups.
CROWD, LEAST_GROUPS = 4, 32
#: Prefix counts from which a hash comes last in the order.
FREQUENT = 64
#: Sets that a task compares with each other.
BLOCK = 2048
#: Hashes of a set that a block counts on; larger sets make smaller blocks.
MEAN = 512
LEAF, FAN = 32, 8
#: A count that a point's 8 bits cannot hold; it bounds nothing.
FULL = 255
#: Rows of sorted groups that are taken up at once.
STEP = 512
#: Bits for each frequent hash, since few sets are to be taken for affected that are not, and the
#: most bits as a power of two; bits for each shared hash.
SPARSE_FREQUENT, MOST_FREQUENT, SPARSE_SHARED = 1024, 24, 8
#: Keys of sets that a task remembers, so as not to describe a copy again.
KNOWN_SETS = 500_000


def point(found: np.ndarray) -> np.ndarray:
    groups = max(LEAST_GROUPS, 1 << (len(found) // CROWD).bit_length())
    counts = np.bincount((found & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return np.minimum(counts, FULL).astype(np.uint8)


def _points(packed: list[bytes]) -> list[np.ndarray]:
    points = [np.frombuffer(x, np.uint8).astype(np.int32) for x in packed]
    for found in points:
        found[found == FULL] = 1 << 22
    return points


def folded(found: np.ndarray, groups: int) -> np.ndarray:
    """A point in fewer groups."""
    while len(found) > groups:
        found = found[: len(found) // 2] + found[len(found) // 2 :]
    return found


def _levels(points: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For every number of groups: the points that have it or twice as many, as rows of a matrix, and
    which of them have just that many. A pair that may link has such a point in one of these."""
    lengths = np.array([len(p) for p in points])
    for groups in np.unique(lengths).tolist():
        at = np.flatnonzero((lengths == groups) | (lengths == 2 * groups))
        yield at, np.stack([folded(points[i], groups) for i in at]), lengths[at] == groups


def prefix_size(size: int) -> int:
    return size - -(-8 * size // 10) + 1


def prefix(found: np.ndarray, late: np.ndarray) -> np.ndarray:
    """The first hashes of a set in the order that has ``late`` ones last."""
    size = prefix_size(len(found))
    last = among(late, found)
    first = found[~last][:size]
    return first if len(first) == size else np.concatenate([first, found[last][: size - len(first)]])


class Tree:
    """An R-tree over points, bulk loaded: halved along the widest coordinate down to leaves."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        order: list[np.ndarray] = []
        todo = [np.arange(len(points))]
        while todo:
            part = todo.pop()
            if len(part) <= LEAF:
                order.append(part)
                continue
            axis = int(np.argmax(np.ptp(points[part], axis=0)))
            part = part[np.argsort(points[part, axis], kind="stable")]
            todo += [part[len(part) // 2 :], part[: len(part) // 2]]
        self.points, self.sizes, self.leaves = points, sizes, order
        high = np.array([points[x].max(axis=0) for x in order])
        least = np.array([sizes[x].min() for x in order])
        self.levels = [(high, least)]
        while len(high) > 1:
            starts = np.arange(0, len(high), FAN)
            high, least = np.maximum.reduceat(high, starts, axis=0), np.minimum.reduceat(least, starts)
            self.levels.append((high, least))

    def search(self, of: int, left: np.ndarray) -> np.ndarray:
        """The points of ``left`` whose bound with a point is high enough."""
        own, size = self.points[of], self.sizes[of]
        nodes = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            high, least = self.levels[depth]
            if depth < len(self.levels) - 1:
                nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
                nodes = nodes[nodes < len(high)]
            bound = np.minimum(high[nodes], own).sum(axis=1)
            nodes = nodes[9 * bound >= 4 * (size + least[nodes])]
            if not len(nodes):
                return nodes
        found = np.concatenate([self.leaves[i] for i in nodes])
        found = found[left[found]]
        bound = np.minimum(self.points[found], own).sum(axis=1)
        return found[9 * bound >= 4 * (size + self.sizes[found])]


def _verified(of: int, found: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Those of some sets that link with a set."""
    if not len(found):
        return found
    own = sets[of]
    lengths = np.array([len(sets[i]) for i in found])
    all_ = np.concatenate([sets[i] for i in found])
    at = np.minimum(np.searchsorted(own, all_), len(own) - 1)
    common = np.add.reduceat(own[at] == all_, np.concatenate([[0], np.cumsum(lengths)[:-1]]), dtype=np.int64)
    return found[100 * common >= 80 * (len(own) + lengths - common)]


def forest(points: list[np.ndarray], sizes: np.ndarray, sets: list[np.ndarray] | None) -> tuple[list[int], list[int]]:
    """Positions of links, or without ``sets`` of surviving pairs, that connect what all of them connect."""
    a: list[int] = []
    b: list[int] = []
    for at, matrix, own in _levels(points):
        if len(at) == 1:
            continue
        tree = Tree(matrix, sizes[at])
        here = [sets[i] for i in at] if sets is not None else None
        left = np.ones(len(at), bool)
        for start in range(len(at)):
            if not left[start]:
                continue
            left[start] = False
            todo = deque([start])
            while todo:
                of = todo.popleft()
                found = tree.search(of, left if own[of] else left & own)
                if here is not None:
                    found = _verified(of, found, here)
                left[found] = False
                a += [int(at[of])] * len(found)
                b += at[found].tolist()
                todo.extend(found.tolist())
    return a, b


def crossing(
    points: list[np.ndarray], sizes: np.ndarray, sets: list[np.ndarray] | None, parts: np.ndarray, probes: np.ndarray
) -> tuple[list[int], list[int]]:
    """Positions of links that join the ``parts`` of ``probes`` with other parts."""
    label = np.unique(parts, return_inverse=True)[1]
    a: list[int] = []
    b: list[int] = []
    for at, matrix, own in _levels(points):
        tree = Tree(matrix, sizes[at])
        here = [sets[i] for i in at] if sets is not None else None
        for of in np.flatnonzero(probes[at]).tolist():
            other = label[at] != label[at[of]]
            found = tree.search(of, other if own[of] else other & own)
            if here is not None:
                found = _verified(of, found, here)
            for i in at[found].tolist():
                if label[i] != label[at[of]]:
                    label[label == label[i]] = label[at[of]]
                    a.append(int(at[of]))
                    b.append(i)
    return a, b


def _by_group(exact: bool, probing: bool):
    """Links within runs of equal (g, salt) of sorted rows (g, salt, key, then size and point, or text if
    ``exact``, then part and probe if ``probing``)."""
    powers = Powers()

    def links(rows: pa.Table) -> pa.RecordBatch:
        keys = rows.column("key").to_numpy()
        sets = None
        if exact:
            texts = [t or b"" for t in rows.column("text").cast(pa.binary()).to_pylist()]
            sets = shingle_sets(texts, WIDTH, powers)[0]
            sizes = np.array([len(x) for x in sets])
            points = _points([point(x).tobytes() for x in sets])
        else:
            sizes = rows.column("size").to_numpy()
            points = _points(rows.column("point").to_pylist())
        g, salt = rows.column("g").to_numpy(), rows.column("salt").to_numpy()
        new = np.flatnonzero((g[1:] != g[:-1]) | (salt[1:] != salt[:-1])) + 1
        starts = np.concatenate([[0], new]).astype(np.int64)
        ends = np.concatenate([new, [len(g)]]).astype(np.int64)
        a: list[int] = []
        b: list[int] = []
        if not probing:
            for i in starts[ends - starts == 2].tolist():  # most groups are pairs
                groups = min(len(points[i]), len(points[i + 1]))
                bound = np.minimum(folded(points[i], groups), folded(points[i + 1], groups)).sum()
                near = 9 * bound >= 4 * (sizes[i] + sizes[i + 1])
                if near and (not exact or len(_verified(i, np.array([i + 1]), sets))):
                    a.append(i)
                    b.append(i + 1)
        for i, j in zip(starts.tolist(), ends.tolist(), strict=True):
            if probing:
                parts = rows.column("part").to_numpy()[i:j]
                probes = rows.column("probe").to_numpy(zero_copy_only=False)[i:j]
                x, y = crossing(points[i:j], sizes[i:j], sets and sets[i:j], parts, probes)
            elif j - i > 2:
                x, y = forest(points[i:j], sizes[i:j], sets and sets[i:j])
            else:
                continue
            a += [i + k for k in x]
            b += [i + k for k in y]
        return pa.RecordBatch.from_arrays([pa.array(keys[a], pa.int64()), pa.array(keys[b], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                g, salt = batch.column("g").to_numpy(), batch.column("salt").to_numpy()
                changed = np.flatnonzero((g != g[-1]) | (salt != salt[-1]))
                first = int(changed[-1]) + 1 if len(changed) else 0
                if held and (g[0] != held[-1].column("g")[0].as_py() or salt[0] != held[-1].column("salt")[0].as_py()):
                    yield links(pa.Table.from_batches(held))
                    held = []
                if first:
                    yield links(pa.Table.from_batches([*held, batch.slice(0, first)]))
                    held = []
                held.append(batch.slice(first))
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def _grouped(rows: DataFrame, exact: bool, probing: bool = False) -> DataFrame:
    columns = ["g", "salt", "key", *(["text"] if exact else ["size", "point"]), *(["part", "probe"] if probing else [])]
    sorted_ = rows.select(*columns).repartition("g", "salt").sortWithinPartitions("g", "salt", "key")
    return stored(sorted_.mapInArrow(_by_group(exact, probing), "a bigint, b bigint").distinct(), "links")


def group_links(members: DataFrame, heads: DataFrame, describe: Callable[[DataFrame], DataFrame], exact: bool) -> DataFrame:
    """``(a, b)``: forests of the links within the groups of ``members(g, key)``.

    Their components are those of all links within groups. ``heads(g, pivot, salts)`` has the
    groups of two or more, a key of each, and in how many blocks it is dealt out. ``describe`` adds
    what is compared, points or texts, to rows with the columns of ``members`` and others; all
    dealing is done before, with keys only.
    """
    salt = F.pmod(F.xxhash64("key"), "salts")
    salted = stored(members.join(heads, "g").withColumn("salt", salt), "dealt")
    large = salted.agg(F.max("salts")).first()[0]
    if large is None or large == 1:
        return _grouped(describe(salted), exact)
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("other")
    pivots = salted.where("key = pivot and salts > 1").select("*", every).where("other != salt")
    pivots = pivots.withColumn("salt", F.col("other")).drop("other")
    within = _grouped(describe(stored(salted.unionByName(pivots), "dealt")), exact)
    parts = connected_components(within)
    several = salted.where("salts > 1").join(parts.withColumnRenamed("node", "key"), "key", "left")
    of_pivots = parts.select(F.col("node").alias("pivot"), F.col("component").alias("pivots_part"))
    several = several.join(of_pivots, "pivot", "left").withColumn("part", F.coalesce("component", "key"))
    several = stored(several.withColumn("probe", F.col("part") != F.coalesce("pivots_part", "pivot")), "blocks")
    # blocks of probes meet all blocks
    probes = several.where("probe")
    lots = several.groupBy("g", "salts").agg(F.count("*").alias("of"), F.count_if("probe").alias("n")).where("n > 0")
    lots = lots.select("g", F.ceil(F.col("salts") * F.col("n") / F.col("of")).cast("bigint").alias("lots"))
    pair = (F.col("salt") * F.col("lots") + F.col("lot")).alias("pair")
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lots") - 1)).alias("lot")
    held = several.join(lots, "g").withColumn("probe", F.lit(False)).select("*", each).select("*", pair)
    sent = probes.join(lots, "g").withColumn("lot", F.pmod(F.xxhash64("key", F.lit(1)), "lots")).select("*", every)
    sent = sent.withColumn("salt", F.col("other")).drop("other").select("*", pair)
    met = stored(held.unionByName(sent).withColumn("salt", F.col("pair")), "dealt")
    return within.unionByName(_grouped(describe(met), exact, probing=True))


def set_key(found: np.ndarray) -> int | None:
    """A signed number for a set, the same for equal sets; None for the empty one."""
    if not len(found):
        return None
    key = xxhash.xxh64_intdigest(found.tobytes())
    return key - (1 << 64) if key >> 63 else key


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    values = np.concatenate([np.empty(0, np.uint64), *parts]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a column of lists, and the row of each."""
    values = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return values, np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))


def _parts(batches: Iterator[pa.RecordBatch], chosen: np.ndarray | None = None):
    """Lots of ids, sets and texts of rows (doc_id, text), of those whose id is ``chosen``."""
    powers = Powers()
    for whole in batches:
        if chosen is not None:
            ids = whole.column(0).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
            whole = whole.filter(pa.array(among(chosen, ids) & ~whole.column(0).is_null().to_numpy(zero_copy_only=False)))
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield batch.column(0), shingle_sets(texts, WIDTH, powers)[0], batch.column(1)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, size, prefix, point) of all rows; prefix and point once for a set."""
    seen: set[int] = set()
    for ids, sets, _ in _parts(batches):
        keys = [set_key(x) for x in sets]
        fresh = []
        for i, key in zip(ids.to_pylist(), keys, strict=True):
            fresh.append(i is not None and key is not None and key not in seen)
            if fresh[-1]:
                if len(seen) >= KNOWN_SETS:
                    seen.clear()
                seen.add(key)
        yield pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array(keys, pa.int64()),
                pa.array([len(x) for x in sets], pa.int64()),
                _lists([x[: prefix_size(len(x))] if new else x[:0] for x, new in zip(sets, fresh, strict=True)]),
                pa.array([point(x).tobytes() if new else None for x, new in zip(sets, fresh, strict=True)], pa.binary()),
            ],
            names=["doc_id", "key", "size", "prefix", "point"],
        )


def _affected(late: np.ndarray):
    """The ids of rows (doc_id, prefix) that have a late hash in their prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, rows = _flat(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.unique(rows[among(late, hashes)])))], names=["doc_id"])

    return run


def _again(late: np.ndarray, chosen: np.ndarray):
    """(key, prefix, added) of affected sets: their prefix in the order of ``late``, and what that added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets, _ in _parts(batches, chosen):
            sets = [x for x in sets if among(late, x[: prefix_size(len(x))]).any()]
            prefixes = [prefix(x, late) for x in sets]
            added = [np.setdiff1d(p, x[: len(p)], assume_unique=True) for p, x in zip(prefixes, sets, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_key(x) for x in sets], pa.int64()), _lists(prefixes), _lists(added)],
                names=["key", "prefix", "added"],
            )

    return run


def _entries(shared: Broadcast, late: np.ndarray | None):
    """(hash, key) of rows (key, prefix): hashes that may be shared, of sets without a late one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, rows = _flat(batch.column(1))
            kept = among(shared.value, hashes)
            if late is not None:
                affected = np.zeros(batch.num_rows, bool)
                affected[rows[among(late, hashes)]] = True
                kept &= ~affected[rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[kept].view(np.int64)), batch.column(0).take(pa.array(rows[kept]))], names=["hash", "key"]
            )

    return run


def _keys(chosen: np.ndarray):
    """(doc_id, key, text) of the rows that are chosen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets, texts in _parts(batches, chosen):
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([set_key(x) for x in sets], pa.int64()), texts], names=["doc_id", "key", "text"]
            )

    return run


def shared_prefixes(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``(hash, key)``: the prefix hashes of sets that more than one set may have there.

    Prefixes in the order of hashes are counted. Sets with a frequent hash among them get another
    prefix, from their texts again; the others have none in the order with frequent ones last
    either. What is in no two prefixes is left out, as far as a bitmap tells.
    """
    given = sets.where(F.size("prefix") > 0)
    counts = given.select(F.explode("prefix").alias("hash")).groupBy("hash").agg(F.count("*").alias("n"))
    counts = stored(counts.where("n > 1"), "counts")
    late = bitmap(counts.where(F.col("n") >= FREQUENT).select("hash"), SPARSE_FREQUENT, MOST_FREQUENT)
    affected = bitmap(stored(given.select("doc_id", "prefix").mapInArrow(_affected(late), "doc_id bigint"), "affected"))
    again = rows.mapInArrow(_again(late, affected), "key bigint, prefix array<bigint>, added array<bigint>")
    again = stored(again, "prefixes")
    added = again.select(F.explode("added").alias("hash"))
    shared = bitmap(counts.select("hash").unionByName(added), SPARSE_SHARED)
    shared = rows.sparkSession.sparkContext.broadcast(shared)  # 16 MB at most, once for both
    schema = "hash bigint, key bigint"
    kept = given.select("key", "prefix").mapInArrow(_entries(shared, late), schema)
    return kept.unionByName(again.select("key", "prefix").mapInArrow(_entries(shared, None), schema))


def distinct_groups(entries: DataFrame) -> DataFrame:
    """``(g, key)``: the groups of two or more keys of distinct ``entries(hash, key)``, each set of keys once."""
    same = F.sum(F.xxhash64("key").cast("decimal(38,0)")).alias("same")
    groups = entries.groupBy("hash").agg(F.count("*").alias("n"), same).where("n > 1")
    groups = groups.groupBy("n", "same").agg(F.min("hash").alias("hash")).select("hash")
    return entries.join(groups, "hash").select(F.col("hash").alias("g"), "key")


def jaccard_join(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: one row per row of ``docs``.

    ``component_id`` is the smallest id reachable over links. Rows without words, or with a NULL
    text, have no shingles and link with nothing. An id with several texts connects them. Rows
    without an id connect nothing; they have the component of an equal set, or NULL. Repeated
    rows stay, and columns other than the two named are not read. Texts of any length are taken
    whole; a text must fit in a task's memory with forty bytes for each of its own.
    """
    rows = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text")
    )
    schema = "doc_id bigint, key bigint, size bigint, prefix array<bigint>, point binary"
    sets = stored(rows.mapInArrow(_described, schema), "sets")
    entries = shared_prefixes(rows, sets).repartition("hash").distinct()
    placed = stored(distinct_groups(entries), "trees")
    named = sets.where("point is not null").join(placed.select("key").distinct(), "key", "left_semi")
    points = named.groupBy("key").agg(F.first("size").alias("size"), F.first("point").alias("point"))
    heads = placed.groupBy("g").agg(
        F.min("key").alias("pivot"), F.ceil(F.count("*") / block).cast("bigint").alias("salts")
    )
    classes = connected_components(group_links(placed, heads, lambda keys: keys.join(points, "key"), False))
    classes = stored(classes.select(F.col("component").alias("g"), F.col("node").alias("key")), "classes")
    chosen = sets.where("point is not null").join(classes, "key").groupBy("key").agg(
        F.first("g").alias("g"), F.min("doc_id").alias("doc_id"), F.first("size").alias("size")
    )
    chosen = stored(chosen, "chosen")
    heads = chosen.groupBy("g").agg(
        F.min("key").alias("pivot"),
        F.ceil(F.greatest(F.count("*") / block, F.sum("size") / (block * MEAN))).cast("bigint").alias("salts"),
    )

    def with_texts(keys: DataFrame) -> DataFrame:
        wanted = bitmap(keys.select("doc_id").distinct())
        texts = rows.mapInArrow(_keys(wanted), "doc_id bigint, key bigint, text string")
        return keys.join(texts, ["doc_id", "key"])

    links = group_links(chosen, heads, with_texts, True)
    # texts under one id
    shared = sets.where("doc_id is not null and key is not null").select("doc_id", "key")
    firsts = shared.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b")
    tied = shared.join(firsts.select("doc_id", "a"), "doc_id").where("a != key").select("a", F.col("key").alias("b"))
    parts = connected_components(links.unionByName(tied))
    known = sets.select("doc_id", "key", "size").join(parts.withColumnRenamed("node", "key"), "key", "left")
    known = known.withColumn("part", F.coalesce("component", "key"))
    least = known.where("part is not null").groupBy("part").agg(F.min("doc_id").alias("least"))
    return known.join(least, "part", "left").select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        F.coalesce("least", F.when(F.col("part").isNull(), F.col("doc_id"))).alias("component_id"),
    )


def op12_count_vector_rtree(spark, sf_dir):
    """Every document's number of shingles and its component at a Jaccard similarity of 0.8."""
    return jaccard_join(table(spark, sf_dir, "documents"))
