"""Interpolated modified Kneser-Ney bigram model, counted in Spark, mapped by workers.

Tokens are lower-cased words and one end per text; the first token's context is the start. Three
passes make the model, each spread by hash over ``shards`` tasks:

1. Token counts. Tasks count what they read before the shuffle; a shard sorts its 64-bit hashes
   and writes them with their counts. A token's number is its place over all shards.
2. Bigram counts, as one BIGINT (context << 32 | token). A context's bigrams go to the shard of
   its hash; those of contexts with more than 1 / (4 shards) of all tokens, of which there are
   at most 4 shards, are dealt over all shards by their token. A shard sorts, adds up and writes
   its bigrams, and the sums of its contexts: total and how many follow once, twice, more often.
3. Left neighbours: for every token the number of different contexts it follows.

The probability of w after v is (c(vw) - D(c)) / c(v) plus the weight freed by the discounts
times the continuation probability of w, which is interpolated in the same way with the uniform
one over the vocabulary and one unknown token. The three discounts of each order come from how
many entries have counts 1 to 4. Scoring maps the sorted arrays and looks up the distinct
tokens and bigrams of a batch in order.

Hashes of tokens are XXH64; two tokens with equal hashes would be one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm.blobs import map_array, write_array
from tickerloom.llm.common import crc_fold, shared_folder, stored, table

FOLDS, HELD_OUT = 5, 1
#: Numbers in place of a token: the start of a text, and one that training has not seen.
START, UNKNOWN = (1 << 31) - 1, (1 << 31) - 2
#: What a task holds before it adds up and hands on.
HELD_TOKENS = 2_000_000
#: Characters of training text for a shard, and bounds of the number of shards.
SHARD_CHARS, SHARDS = 8_000_000, (8, 1 << 22)
#: Arrays that a worker keeps mapped at once.
MAPPED = 8192
#: What a context's array files have: all that follows, and what follows once, twice, more often.
SUMS = ("total", "once", "twice", "more")
MASK = (1 << 32) - 1


def tokens(text: bytes | None) -> list[bytes]:
    """The words of a text and its end, which is the empty word."""
    return [*(text or b"").lower().split(), b""]


class _Hashes(dict):
    """Hashes of words; forgets all when full, so that it stays small."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _hashed(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[tuple]:
    """Runs of texts: (rows of other columns, token hashes, tokens of each text)."""
    known = _Hashes()
    for batch in batches:
        begin, held, lengths = 0, [], []
        texts = batch.column(column).cast(pa.binary())
        size = 0
        for row, text in enumerate(texts, 1):
            found = tokens(text.as_py())
            held.append(np.fromiter(map(known.__getitem__, found), np.uint64, len(found)))
            lengths.append(len(found))
            size += len(found)
            if size >= most:
                yield batch.slice(begin, row - begin), np.concatenate(held), np.array(lengths)
                begin, held, lengths, size = row, [], [], 0
        if held:
            yield batch.slice(begin), np.concatenate(held), np.array(lengths)


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, int)
    return keys[first], *(np.add.reduceat(c[order], first) if len(first) else c for c in counts)


def _rows(*columns: np.ndarray | list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of each shard in a task, once all have come; the first column is the shard.

    Shards are dealt by their number, one a task, and their number follows the corpus, so a task
    holds a few million rows at most."""
    parts = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
    if parts:
        whole = [np.concatenate(c) for c in zip(*parts, strict=True)]
        order = np.argsort(whole[0], kind="stable")
        cuts = np.flatnonzero(np.diff(whole[0][order])) + 1
        for rows in np.split(order, cuts):
            yield int(whole[0][rows[0]]), [c[rows] for c in whole]


@dataclass
class Model:
    """Where the arrays are, and the few numbers that scoring needs besides."""

    folder: str
    bits: int
    #: The first token number of every shard, and the number of tokens at the end.
    offsets: list[int] = field(default_factory=list)
    train_tokens: int = 0
    #: Sums of the contexts that are dealt over all shards, the start among them.
    hot: dict[int, tuple[int, ...]] = field(default_factory=dict)
    bigram_discounts: list[float] = field(default_factory=list)
    left_discounts: list[float] = field(default_factory=list)
    #: Different bigrams, and what the discounts of left neighbours free of them.
    left_total: int = 0
    left_free: float = 0.0

    @property
    def shards(self) -> int:
        return 1 << self.bits

    @property
    def vocabulary(self) -> int:
        return self.offsets[-1]

    def size(self, shard: int) -> int:
        return self.offsets[shard + 1] - self.offsets[shard]

    def token_shards(self, ids: np.ndarray) -> np.ndarray:
        """The shard that numbers a token; numbers must be in range."""
        return np.searchsorted(self.offsets, ids, side="right") - 1

    def homes(self, contexts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The shard of a bigram: its context's, or by its token if the context is hot."""
        home = np.minimum(self.token_shards(contexts), self.shards - 1)
        dealt = (ids * 0x9E3779B1 >> 7) % self.shards
        return np.where(np.isin(contexts, list(self.hot)), dealt, home)


def _hash_shards(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _runs(sorted_shards: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each shard in a sorted array and where it stands."""
    for shard in np.unique(sorted_shards).tolist():
        yield shard, slice(*np.searchsorted(sorted_shards, [shard, shard + 1]))


class Mapped:
    """The arrays of a model in a worker, mapped when first needed."""

    def __init__(self, model: Model) -> None:
        self.model, self.opened = model, {}

    def array(self, name: str, shard: int) -> np.ndarray:
        key = f"{name}-{shard}"
        if key not in self.opened:
            if len(self.opened) >= MAPPED:
                self.opened.clear()
            self.opened[key] = map_array(self.model.folder, key)
        return self.opened[key]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Token numbers of sorted distinct hashes, UNKNOWN where training has none."""
        found = np.full(len(hashes), UNKNOWN, np.int64)
        for shard, rows in _runs(_hash_shards(hashes, self.model.bits)):
            if self.model.size(shard):
                known = self.array("hash", shard)
                at = np.minimum(np.searchsorted(known, hashes[rows]), len(known) - 1)
                number = self.model.offsets[shard] + at
                found[rows] = np.where(known[at] == hashes[rows], number, UNKNOWN)
        return found

    def gather(self, name: str, ids: np.ndarray) -> np.ndarray:
        """What an array by token number has for sorted numbers; 0 for UNKNOWN and START."""
        found = np.zeros(len(ids), np.int64)
        inside = ids[: np.searchsorted(ids, self.model.vocabulary)]
        for shard, rows in _runs(self.model.token_shards(inside)):
            found[: len(inside)][rows] = self.array(name, shard)[inside[rows] - self.model.offsets[shard]]
        return found

    def times(self, keys: np.ndarray) -> np.ndarray:
        """Counts of bigrams in training."""
        found = np.zeros(len(keys), np.int64)
        home = self.model.homes(keys >> 32, keys & MASK)
        order = np.lexsort((keys, home))
        for shard, rows in _runs(home[order]):
            known, wanted = self.array("bigram", shard), keys[order[rows]]
            if len(known):
                at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                found[order[rows]] = np.where(known[at] == wanted, self.array("times", shard)[at], 0)
        return found


def _contexts(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The context of every token."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.cumsum(lengths) - lengths] = START
    return before


def _discounts(n: list[int]) -> list[float]:
    """Discounts of counts 1, 2 and more, from how many entries have counts 1, 2, 3 and 4.

    Where one of these is 0, as in tiny corpora, halves of the counts stand in; a discount never
    exceeds its count.
    """
    if min(n) <= 0:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    raw = (k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))
    return [min(max(d, 0.01), float(k)) for k, d in zip((1, 2, 3), raw, strict=True)]


def _discounted(counts: np.ndarray, discounts: list[float]) -> np.ndarray:
    return counts - np.array([0.0, *discounts])[np.minimum(counts, 3)]


def _count_tokens(texts: DataFrame, model: Model) -> None:
    """Pass 1: write the sorted hashes and counts of every shard; set offsets and total."""
    bits, folder = model.bits, model.folder

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            shard = _hash_shards(keys, bits).astype(np.int32)
            return _rows(shard, keys.view(np.int64), times, names=["shard", "hash", "n"])

        keys, times = np.empty(0, np.uint64), np.empty(0, np.int64)
        for _, hashes, _ in _hashed(batches, 0, HELD_TOKENS):
            new, n = np.unique(hashes, return_counts=True)
            keys, times = _summed(np.concatenate([keys, new]), np.concatenate([times, n]))
            if len(keys) > HELD_TOKENS:
                yield out(keys, times)
                keys, times = keys[:0], times[:0]
        yield out(keys, times)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (_, hashes, n) in _by_shard(batches):
            keys, times = _summed(hashes.view(np.uint64), n)
            write_array(folder, f"hash-{shard}", keys)
            write_array(folder, f"count-{shard}", times)
            yield _rows([shard], [len(keys)], [times.sum()], names=["shard", "size", "n"])

    dealt = texts.mapInArrow(count, "shard int, hash bigint, n bigint")
    written = dealt.repartitionById(model.shards, F.col("shard")).mapInArrow(write, "shard bigint, size bigint, n bigint")
    found = {r.shard: r for r in written.collect()}  # one row a shard
    sizes = [found[s].size if s in found else 0 for s in range(model.shards)]
    model.offsets = [0, *np.cumsum(sizes).tolist()]
    model.train_tokens = sum(r.n for r in found.values())
    if model.vocabulary >= UNKNOWN:
        raise ValueError("token numbers have 31 bits; the corpus has more different tokens")


def _find_hot(spark: SparkSession, model: Model) -> None:
    """Set the contexts with more than 1 / (4 shards) of all tokens: 4 shards of them at most."""
    limit = model.train_tokens / (4 * model.shards)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped = Mapped(model)
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                if model.size(shard):
                    often = np.flatnonzero(mapped.array("count", shard) > limit)
                    yield _rows(often + model.offsets[shard], names=["id"])

    found = spark.range(model.shards).mapInArrow(frequent, "id bigint").collect()
    model.hot = {START: (0, 0, 0, 0), **{r.id: (0, 0, 0, 0) for r in found}}


def _count_bigrams(texts: DataFrame, model: Model) -> DataFrame:
    """Pass 2: write the bigrams and contexts of every shard; returns what adds up over shards.

    ``kind`` 0: sums of a hot context; 1: left neighbours of a token, ``home`` its shard; 2:
    how many bigrams have a count of ``id`` in 1 to 4.
    """
    names = ["kind", "home", "id", "total", "once", "twice", "more"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped = Mapped(model)
        for _, hashes, lengths in _hashed(batches, 0, HELD_TOKENS):
            distinct, place = np.unique(hashes, return_inverse=True)
            ids = mapped.numbers(distinct)[place]
            keys, n = np.unique(_contexts(ids, lengths) << 32 | ids, return_counts=True)
            home = model.homes(keys >> 32, keys & MASK).astype(np.int32)
            yield _rows(home, keys, n.astype(np.int32), names=["shard", "key", "n"])

    def report(kind: int, home: np.ndarray, ids: np.ndarray, sums: list[np.ndarray]) -> pa.RecordBatch:
        sums = [*sums, *[np.zeros(len(ids), np.int64)] * (4 - len(sums))]
        return _rows(np.full(len(ids), kind, np.int32), home.astype(np.int32), ids, *sums, names=names)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (_, keys, n) in _by_shard(batches):
            keys, n = _summed(keys[keys >= 0], n[keys >= 0].astype(np.int64))
            write_array(model.folder, f"bigram-{shard}", keys)
            write_array(model.folder, f"times-{shard}", n.astype(np.int32))
            parts = [n, *((m).astype(np.int64) for m in (n == 1, n == 2, n > 2))]
            contexts, *sums = _summed(keys >> 32, *parts)
            shared = np.isin(contexts, list(model.hot))
            for name, values in zip(SUMS, sums, strict=True):
                aligned = np.zeros(model.size(shard), np.int64)
                aligned[contexts[~shared] - model.offsets[shard]] = values[~shared]
                write_array(model.folder, f"{name}-{shard}", aligned)
            yield report(0, contexts[shared] * 0, contexts[shared], [s[shared] for s in sums])
            ids, lefts = np.unique(keys & MASK, return_counts=True)
            yield report(1, model.token_shards(ids), ids, [lefts])
            seen = np.bincount(np.minimum(n, 5), minlength=6)[1:5]
            yield report(2, seen * 0, np.arange(1, 5), [seen])

    # a bigram that is none makes sure that every shard is written
    none = texts.sparkSession.range(model.shards).select(
        F.col("id").cast("int").alias("shard"), F.lit(-1).cast("bigint").alias("key"), F.lit(0).alias("n")
    )
    dealt = texts.mapInArrow(count, "shard int, key bigint, n int").union(none)
    schema = "kind int, home int, id bigint, total bigint, once bigint, twice bigint, more bigint"
    return dealt.repartitionById(model.shards, F.col("shard")).mapInArrow(write, schema)


def _finish(sums: DataFrame, model: Model) -> None:
    """Pass 3: write the left neighbours of every shard; set hot sums and discounts."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, (_, ids, n) in _by_shard(batches):
            aligned = np.zeros(model.size(shard), np.int64)
            np.add.at(aligned, ids - model.offsets[shard], n)
            write_array(model.folder, f"left-{shard}", aligned)
            seen = np.bincount(np.minimum(aligned, 5), minlength=6)
            total = aligned.sum()
            yield _rows([total], *([v] for v in seen[1:].tolist()), names=["total", "a", "b", "c", "d", "e"])

    small = sums.where("kind != 1").groupBy("kind", "id").agg(*(F.sum(c).alias(c) for c in SUMS))
    rows = small.collect()  # one row a hot context, and four
    model.hot |= {r.id: tuple(r[c] for c in SUMS) for r in rows if r.kind == 0}
    seen = {r.id: r.total for r in rows if r.kind == 2}
    model.bigram_discounts = _discounts([seen.get(k, 0) for k in (1, 2, 3, 4)])
    dealt = sums.where("kind = 1").select("home", "id", "total").repartitionById(model.shards, F.col("home"))
    schema = "total bigint, a bigint, b bigint, c bigint, d bigint, e bigint"
    lefts = dealt.mapInArrow(write, schema).collect()  # one row a shard
    total, a, b, c, d, e = (sum(r[i] for r in lefts) for i in range(6))
    model.left_discounts = d1, d2, d3 = _discounts([a, b, c, d])
    model.left_total = total
    model.left_free = (d1 * a + d2 * b + d3 * (c + d + e)) / total if total else 1.0


def train(texts: DataFrame) -> Model:
    """A model of the ``text`` column; NULL counts as an empty text, which has one token."""
    spark = texts.sparkSession
    chosen = texts.select(F.col("text").cast("string"))
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    low, high = SHARDS
    shards = min(max(low, size // SHARD_CHARS), high)
    model = Model(shared_folder(spark, "kneser-ney"), (shards - 1).bit_length())
    _count_tokens(chosen, model)
    _find_hot(spark, model)
    _finish(stored(_count_bigrams(chosen, model), "sums"), model)
    return model


def token_scores(mapped: Mapped, hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """For every token: its count in training, and log10 of its probability."""
    model = mapped.model
    distinct, place = np.unique(hashes, return_inverse=True)
    numbers = mapped.numbers(distinct)
    counts = mapped.gather("count", np.sort(numbers))[np.argsort(np.argsort(numbers, kind="stable"))]
    ids = numbers[place]
    # all that depends on a token or a context alone is worked out once for each number
    kinds = np.unique(np.append(numbers, START))
    lefts = mapped.gather("left", kinds)
    sums = np.stack([mapped.gather(name, kinds) for name in SUMS])
    for i in np.flatnonzero(np.isin(kinds, list(model.hot))).tolist():
        sums[:, i] = model.hot[int(kinds[i])]
    total = np.maximum(sums[0], 1)
    free = np.where(sums[0] > 0, np.array(model.bigram_discounts) @ sums[1:] / total, 1.0)
    uniform = model.left_free / (model.vocabulary + 1)
    low = _discounted(lefts, model.left_discounts) / max(model.left_total, 1) + uniform

    contexts = _contexts(ids, lengths)
    keys, where = np.unique(contexts << 32 | ids, return_inverse=True)
    at, of = np.searchsorted(kinds, keys >> 32), np.searchsorted(kinds, keys & MASK)
    times = np.zeros(len(keys), np.int64)
    known = (sums[0][at] > 0) & ((keys & MASK) < UNKNOWN)
    times[known] = mapped.times(keys[known])
    chance = _discounted(times, model.bigram_discounts) / total[at] + free[at] * low[of]
    return counts[place], np.log10(chance)[where]


def score(docs: DataFrame, model: Model, keep: list[str], text_column: str = "text") -> DataFrame:
    """``keep`` with ``n_tokens, n_known, base_score, score, perplexity`` of every row.

    ``score`` is log10 of the text's probability, ``base_score`` that of single tokens with half
    a count added. A NULL text counts as empty and is scored by its end; repeated rows are scored
    each. With nothing to learn from every probability is 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped = Mapped(model)
        spread = model.train_tokens + 0.5 * (model.vocabulary + 1)
        for rows, hashes, lengths in _hashed(batches, len(keep), HELD_TOKENS // 4):
            counts, chances = token_scores(mapped, hashes, lengths)
            starts = np.cumsum(lengths) - lengths
            added = [np.add.reduceat(v, starts) for v in (counts > 0, np.log10((counts + 0.5) / spread), chances)]
            out = [lengths, added[0].astype(np.int64), added[1], added[2], 10 ** (-added[2] / lengths)]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:-1], *map(pa.array, out)],
                names=[*keep, "n_tokens", "n_known", "base_score", "score", "perplexity"],
            )

    rows = docs.select(*keep, F.col(text_column).cast("string").alias("_text"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(
        run, f"{schema}, n_tokens bigint, n_known bigint, base_score double, score double, perplexity double"
    )


def op9_kneser_ney(spark, sf_dir):
    held_out = F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    model = train(docs.where("not held_out"))
    return score(docs, model, ["doc_id", "held_out"]).withColumn(
        "train_tokens", F.lit(model.train_tokens).cast("bigint")
    )
