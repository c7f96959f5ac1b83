"""Best-fit packing of documents into windows, constrained by conflicts.

A window ("bin") holds at most ``capacity`` words, and no two pieces from the same source or the
same cluster of near copies. Documents longer than a window are cut into pieces, which conflict
like any others; a piece that fills a window has it to itself.

Clusters are components of texts whose five-word shingle sets have a Jaccard similarity of 0.8 or
more. Candidates agree in a band of one-permutation MinHash values, of which a text has ``BANDS *
ROWS``: a pair of similarity 0.8 is missed seven times in 100,000. They are then compared exactly, so
that pages of one template, which agree in a band now and then, stay apart.

Pieces go to shards by a hash, with the number of shards following the number of words, and each
shard is packed on its own in one bounded group: pieces in order of falling length, each into
the tightest bin that is compatible. Bins are ordered by what is left in them and carry bitmaps
of their sources and clusters. The search begins at the smallest residual that fits and goes on
to the next greater one until a bin has neither bit in common with the piece; a residual at which
all bins share the piece's source is passed over at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.bitmaps import among, bitmap
from tickerloom.llm.common import stored, table
from tickerloom.llm.components import connected_components
from tickerloom.llm.count_tree import BLOCK, MEAN, distinct_groups, group_links, point, set_key
from tickerloom.llm.hashing import Powers, mixed, shingle_sets

CAPACITY = 2048
#: Words of the pieces of a shard; a few thousand bins, and some tens of thousands of pieces.
SHARD_WORDS = 4_000_000
#: Words of a shingle, bands of MinHash values, and values of a band.
WIDTH = 5
BANDS = 24
ROWS = 5
#: Keys of texts that a task remembers, so as not to describe a copy again.
KNOWN = 500_000


class Bins:
    """Open bins of one shard by residual."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        #: Bit r: some bin has r words left.
        self.filled = 0
        #: For each residual the source and cluster bits that all its bins share: a lower bound
        #: while bins leave.
        self.shared: list[tuple[int, int]] = [(0, 0)] * (capacity + 1)
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.left: list[int] = []
        #: The cluster of the last piece that had one, and the residuals at which all bins have it.
        self.cluster = self.barren = 0

    def _put(self, bin_: int) -> None:
        r = self.left[bin_]
        source, cluster = self.sources[bin_], self.clusters[bin_]
        if self.at[r]:
            source, cluster = self.shared[r][0] & source, self.shared[r][1] & cluster
        self.shared[r] = source, cluster
        if not self.clusters[bin_] & self.cluster:
            self.barren &= ~(1 << r)
        self.at[r].append(bin_)
        self.filled |= 1 << r

    def _find(self, length: int, source: int, cluster: int) -> int | None:
        """The tightest compatible bin, taken out of its place; of equals the last that got there."""
        rest = (self.filled & ~self.barren if cluster else self.filled) >> length
        r = length
        while rest:
            step = (rest & -rest).bit_length() - 1
            r += step
            sources, clusters = self.shared[r]
            if clusters & cluster:
                self.barren |= 1 << r
            elif not sources & source:
                bins = self.at[r]
                for i in range(len(bins) - 1, -1, -1):
                    bin_ = bins[i]
                    if not self.sources[bin_] & source and not self.clusters[bin_] & cluster:
                        bins.pop(i)
                        if not bins:
                            self.filled &= ~(1 << r)
                        return bin_
            rest >>= step + 1
            r += 1
        return None

    def place(self, length: int, source: int, cluster: int) -> int:
        """The bin of a piece."""
        if cluster and cluster != self.cluster:
            self.cluster, self.barren = cluster, 0
        bin_ = self._find(length, source, cluster)
        if bin_ is None:
            bin_ = len(self.left)
            self.left.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        self.left[bin_] -= length
        self.sources[bin_] |= source
        self.clusters[bin_] |= cluster
        self._put(bin_)
        return bin_


def _bits(values: np.ndarray) -> list[int]:
    """A bit for every value that occurs twice or more; others conflict with nothing."""
    _, place, times = np.unique(values, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    return [1 << int(number[p]) if times[p] > 1 else 0 for p in place]


def pack(lengths: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of every piece; pieces come in order of falling length."""
    bins = Bins(capacity)
    source, cluster = _bits(sources), _bits(clusters)
    return np.array([bins.place(*p) for p in zip(lengths.tolist(), source, cluster, strict=True)], np.int64)


def _buckets(shingles: np.ndarray) -> np.ndarray:
    """A signed 64-bit number for each band of a set's one-permutation MinHash values.

    A value is the least hash of a part of the hashes; a part without any takes that of the next
    part that has one, told apart by the distance.
    """
    parts = BANDS * ROWS
    values = mixed(shingles)
    of = (values % np.uint64(parts)).astype(np.int64)
    least = np.full(parts, np.iinfo(np.uint64).max)
    np.minimum.at(least, of, values)
    there = np.unique(of)
    following = np.searchsorted(there, np.arange(parts))
    source = there[following % len(there)]
    with np.errstate(over="ignore"):
        far = ((source - np.arange(parts)) % parts).astype(np.uint64)
        least = mixed(least[source] + far)
        found = np.arange(BANDS, dtype=np.uint64)
        for row in least.reshape(BANDS, ROWS).T:
            found = mixed(found ^ row)
    return found.view(np.int64)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, source, words, cluster, size, buckets, point) of rows (doc_id, source, text); the
    last two once for a set."""
    powers, seen = Powers(), set()
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
            sets, words = shingle_sets(texts, WIDTH, powers)
            keys = [set_key(x) for x in sets]
            buckets, points = [], []
            for key, found in zip(keys, sets, strict=True):
                new = key is not None and key not in seen
                if new:
                    if len(seen) >= KNOWN:
                        seen.clear()
                    seen.add(key)
                buckets.append(_buckets(found) if new else None)
                points.append(point(found).tobytes() if new else None)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array(words, pa.int64()),
                    pa.array([key or 0 for key in keys], pa.int64()),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array(buckets, pa.list_(pa.int64())),
                    pa.array(points, pa.binary()),
                ],
                names=["doc_id", "source", "words", "cluster", "size", "buckets", "point"],
            )


def _chosen(wanted: np.ndarray):
    """(key, text) of the texts whose set may be wanted, each once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seen = Powers(), set()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
                keys = np.array([set_key(x) or 0 for x in shingle_sets(texts, WIDTH, powers)[0]], np.int64)
                rows = []
                for i in np.flatnonzero(among(wanted, keys.view(np.uint64))).tolist():
                    if int(keys[i]) not in seen:
                        rows.append(i)
                        if len(seen) >= KNOWN:
                            seen.clear()
                        seen.add(int(keys[i]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[rows]), batch.column(0).take(pa.array(rows, pa.int64()))], names=["key", "text"]
                )

    return run


def near_clusters(texts: DataFrame, described: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(cluster, near)``: the least cluster of the near copies of a cluster, for those that have any.

    ``texts`` has one column, from which ``described`` was made. Sets that share a bucket are
    compared by their points, and classes of what remains by their texts. Texts without words have
    no near copies.
    """
    new = described.where("point is not null")
    entries = new.select(F.explode("buckets").alias("hash"), F.col("cluster").alias("key")).repartition("hash").distinct()
    placed = stored(distinct_groups(entries), "buckets")
    named = new.withColumnRenamed("cluster", "key").join(placed.select("key").distinct(), "key", "left_semi")
    points = named.groupBy("key").agg(F.first("size").alias("size"), F.first("point").alias("point"))
    heads = placed.groupBy("g").agg(F.min("key").alias("pivot"), F.ceil(F.count("*") / block).cast("bigint").alias("salts"))
    classes = connected_components(group_links(placed, heads, lambda keys: keys.join(points, "key"), False))
    classes = classes.select(F.col("component").alias("g"), F.col("node").alias("key"))
    classes = stored(classes.join(points.select("key", "size"), "key"), "classes")
    heads = classes.groupBy("g").agg(
        F.min("key").alias("pivot"),
        F.ceil(F.greatest(F.count("*") / block, F.sum("size") / (block * MEAN))).cast("bigint").alias("salts"),
    )

    def with_texts(keys: DataFrame) -> DataFrame:
        wanted = bitmap(keys.select("key").distinct())
        return keys.join(texts.mapInArrow(_chosen(wanted), "key bigint, text string").dropDuplicates(["key"]), "key")

    near = connected_components(group_links(classes, heads, with_texts, True))
    return near.select(F.col("node").alias("cluster"), F.col("component").alias("near"))


def pieces(described: DataFrame, capacity: int) -> DataFrame:
    """``(doc_id, copy, source, cluster, start, length)``: spans of words, one or more a row.

    The cluster stands for the set of shingles, so texts that differ in the case of A to Z and in
    white space are duplicates. Equal rows are counted before they are dealt, and then told apart by
    ``copy``, so that many of them spread. Texts without words have one piece of length 0.
    """
    counted = described.groupBy("doc_id", "source", "cluster", "words").agg(F.count("*").alias("n"))
    copies = counted.select(
        "doc_id", "source", "cluster", "words",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("copy"),
    )
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("words") - 1, F.lit(0)), F.lit(capacity).cast("bigint"))
    return copies.select(
        "doc_id", "copy", "source", "cluster", "words", F.explode(starts).alias("start")
    ).select(
        "doc_id", "copy", "source", "cluster", "start",
        F.least(F.col("words") - F.col("start"), F.lit(capacity)).alias("length"),
    )


def packed(
    docs: DataFrame,
    capacity: int = CAPACITY,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``(doc_id, copy, start, length, bin_id, bin_words, bin_pieces)``: every piece once.

    ``start`` and ``length`` count words; ``bin_id`` is ``shard:number``. NULL and empty texts
    have one piece of no words, which takes part in conflicts like any other. NULL sources are
    one source, NULL ids are ids. Repeated rows are copies 0, 1, ...; they are duplicates and so
    never share a bin, and neither do near copies. Other columns are not read.
    """
    text = F.col(text_column).cast("string").alias("text")
    rows = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"), F.xxhash64(F.col(source_column).cast("string")).alias("source"), text
    )
    schema = "doc_id bigint, source bigint, words bigint, cluster bigint, size bigint, buckets array<bigint>, point binary"
    described = stored(rows.mapInArrow(_described, schema), "described")
    cut = pieces(described, capacity).join(near_clusters(docs.select(text), described), "cluster", "left")
    cut = stored(cut.withColumn("near", F.coalesce("near", "cluster")), "pieces")
    # one row: how much there is
    size = cut.agg(F.sum("length").alias("words"), F.count("*").alias("n")).first()
    weight = max(size.words or 0, size.n * 50)
    shards = max(1, -(-weight // shard_words))
    shard = F.pmod(F.xxhash64("doc_id", "copy", "start", "cluster"), F.lit(shards))

    def run(key: tuple, found: pa.Table) -> pa.Table:
        found = found.sort_by(
            [("length", "descending"), *((c, "ascending") for c in ("doc_id", "copy", "start", "cluster"))]
        )
        get = lambda c: found.column(c).to_numpy()
        bins = pack(get("length"), get("source"), get("near"), capacity)
        filled = np.bincount(bins, weights=get("length")).astype(np.int64)
        names = pa.array([f"{key[0].as_py()}:{b}" for b in bins.tolist()])
        return pa.table(
            [
                *(found.column(c) for c in ("doc_id", "copy", "start", "length")),
                names,
                pa.array(filled[bins]),
                pa.array(np.bincount(bins)[bins]),
            ],
            names=["doc_id", "copy", "start", "length", "bin_id", "bin_words", "bin_pieces"],
        )

    schema = (
        "doc_id bigint, copy bigint, start bigint, length bigint, "
        "bin_id string, bin_words bigint, bin_pieces bigint"
    )
    return cut.withColumn("shard", shard).groupBy("shard").applyInArrow(run, schema)


def op2_bestfit_packing(spark, sf_dir):
    """Every piece of every document with its window of 2048 words."""
    return packed(table(spark, sf_dir, "documents"))


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every document's pieces go: the last stage of the pipeline."""
    return packed(docs)
