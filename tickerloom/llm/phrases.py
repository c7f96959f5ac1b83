"""Phrase collocations, counted through a prefix-free parsing of the corpus.

Pieces of text are cut into chunks at content: a chunk ends with any two words whose hash falls on
one of ``PERIOD`` values, and the next chunk begins with the same two words. Equal stretches of text
are therefore cut alike wherever they stand, and the corpus becomes a dictionary of distinct chunks
with the frequency of each in the parse. N-grams are counted inside distinct chunks, weighted by
frequency. Chunks overlap in the two words of a trigger, so an n-gram of up to three words belongs to
the one chunk that has its first word before the last two, or anywhere if the chunk ends its piece.

Counts run over the dictionary twice. The first run sums words and pairs under 64-bit hashes, and
those that may occur often enough set bits in a bitmap. The second counts the words themselves,
exactly, of n-grams that are not ruled out: pairs by their own bit, triples by those of both pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.bitmaps import among, bitmap
from tickerloom.llm.common import stored, table
from tickerloom.llm.hashing import C2, Powers, lots, mixed, words_in

LONGEST = 3
LEAST = 10
#: Percent of a phrase's occurrences inside one longer phrase that drop it.
INSIDE = 50
TOP = 2000
SCALE = 1_000_000
PERIOD = 8
UNKNOWN = "und"
#: What ends a piece, turned into line ends; what separates words, turned into spaces.
PIECES = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
#: Last byte of a chunk that ends its piece, and of one that goes on in the next.
CLOSED, OPEN = 10, 9
#: Bytes of chunks that are counted at once.
TOGETHER = 12_000_000
#: Bits of the bitmap for each n-gram that is often enough.
SPARSE = 64


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of pairs of hashes."""
    with np.errstate(over="ignore"):
        return mixed(mixed(first) * C2 + second)


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some spans one after another, and their offsets."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)], offsets


def _array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.StringArray.from_buffers(len(offsets) - 1, buffers[1], buffers[2])


def parse(texts: list[bytes], powers: Powers, period: int = PERIOD) -> tuple[pa.Array, np.ndarray]:
    """The chunks of some texts, and the text of each.

    Words stand with one space between them. The last byte tells how a chunk ends: with its piece
    (``CLOSED``) or with a trigger, whose two words the next chunk begins with (``OPEN``).
    """
    data = np.frombuffer((b"\n" + b"\n".join(texts) + b"\n").lower().translate(PIECES), np.uint8)
    hashes, starts, ends = words_in(data, powers)
    if not len(hashes):
        return pa.array([], pa.string()), np.empty(0, np.int64)
    lines = np.cumsum(data == CLOSED)
    last = np.concatenate([lines[starts[1:]] != lines[ends[:-1] - 1], [True]])
    trigger = (_pairs(hashes[:-1], hashes[1:]) % np.uint64(period) == 0) & ~last[:-1] & ~last[1:]
    at = np.flatnonzero(trigger) + 1
    begin = np.sort(np.concatenate([[0], np.flatnonzero(last[:-1]) + 1, at - 1]))
    end = np.sort(np.concatenate([np.flatnonzero(last), at]))
    # words with the one byte after each
    spaced, offsets = _strings(data, starts, ends + 1)
    spaced[offsets[1:] - 1] = ord(" ")
    chunks, bounds = _strings(spaced, offsets[begin], offsets[end + 1])
    chunks[bounds[1:] - 1] = np.where(last[end], CLOSED, OPEN)
    texts_at = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return _array(chunks, bounds), np.searchsorted(texts_at, starts[begin], "right") - 1


def _parsed(period: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = batch.column(1).cast(pa.binary()).to_pylist()
                for start, stop in lots(texts):
                    chunks, of = parse(texts[start:stop], powers, period)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of + start)), chunks], names=["lang", "chunk"])

    return run


class Lot:
    """Some distinct chunks with the places of their words."""

    def __init__(self, batches: list[pa.RecordBatch], powers: Powers) -> None:
        rows = pa.Table.from_batches(batches).combine_chunks()
        named = rows.column("lang").chunk(0).dictionary_encode()
        self.langs, lang = named.dictionary, named.indices.to_numpy()
        chunks = rows.column("chunk").chunk(0)
        offsets = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset : chunks.offset + len(chunks) + 1]
        held = np.frombuffer(chunks.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets.astype(np.int64) - offsets[0] + 1
        self.data = np.concatenate([[np.uint8(CLOSED)], held])
        hashes, self.starts, self.ends = words_in(self.data, powers)
        row = np.searchsorted(offsets, self.starts, "right") - 1
        self.lang = lang[row]
        seeds = np.array([xxhash.xxh64_intdigest(x) for x in self.langs.to_pylist()], np.uint64)
        with np.errstate(over="ignore"):
            #: Hashes of words, told apart by language.
            self.hashes = mixed(hashes + seeds[self.lang])
        #: Words from each up to its chunk's end, it included.
        self.left = np.searchsorted(self.starts, offsets[1:])[row] - np.arange(len(row))
        #: How often the n-grams that begin here count; not at all in the overlap with the next chunk.
        goes_on = self.data[offsets[1:] - 1] == OPEN
        self.weights = rows.column("n").to_numpy()[row]
        self.weights[(self.left < LONGEST) & goes_on[row]] = 0


def _groups(keys: np.ndarray, *parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that has equal keys together, and where in it the groups with equal ``parts`` begin."""
    order = np.argsort(keys)
    new = np.zeros(len(keys), bool)
    new[:1] = True
    for part in (keys, *parts):
        part = part[order]
        new[1:] |= part[1:] != part[:-1]
    return order, np.flatnonzero(new)


def _runs(count: Callable[[Lot], pa.RecordBatch]):
    """Apply ``count`` to lots of rows (lang, chunk, n) of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, size = Powers(), [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.column(1).get_total_buffer_size()
            if size >= TOGETHER:
                yield count(Lot(held, powers))
                held, size = [], 0
        if held:
            yield count(Lot(held, powers))

    return run


def _hashed(lot: Lot) -> pa.RecordBatch:
    """Weights of words and pairs under their hashes."""
    one = np.flatnonzero(lot.weights > 0)
    two = one[lot.left[one] > 1]
    keys = np.concatenate([mixed(lot.hashes[one]), _pairs(lot.hashes[two], lot.hashes[two + 1])])
    order, first = _groups(keys)
    sums = np.add.reduceat(np.concatenate([lot.weights[one], lot.weights[two]])[order], first) if len(keys) else np.empty(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(keys[order[first]].view(np.int64)), pa.array(sums)], names=["hash", "n"])


def _spelled(often: np.ndarray):
    def count(lot: Lot) -> pa.RecordBatch:
        """Weights of the n-grams that ``often`` does not rule out, as words."""
        counted = lot.weights > 0
        pair = np.zeros(len(lot.hashes) + 1, bool)
        inside = np.flatnonzero(lot.left > 1)
        pair[inside] = among(often, _pairs(lot.hashes[inside], lot.hashes[inside + 1]))
        begins = [
            np.flatnonzero(counted & among(often, mixed(lot.hashes))),
            np.flatnonzero(counted & pair[:-1]),
            np.flatnonzero(counted & pair[:-1] & pair[1:] & (lot.left > 2)),
        ]
        found = []
        for more, at in enumerate(begins):
            if not len(at):
                continue
            parts = [lot.hashes[at + k] for k in range(more + 1)]
            key = parts[0]
            for part in parts[1:]:
                key = _pairs(key, part)
            order, first = _groups(key, *parts)
            here = at[order[first]]
            found.append((here, here + more, np.add.reduceat(lot.weights[at[order]], first), more + 1))
        here = np.concatenate([np.empty(0, np.int64), *(x[0] for x in found)])
        ends = np.concatenate([np.empty(0, np.int64), *(x[1] for x in found)])
        return pa.RecordBatch.from_arrays(
            [
                lot.langs.take(pa.array(lot.lang[here])),
                pa.array(np.concatenate([np.empty(0, np.int32), *(np.full(len(x[0]), x[3], np.int32) for x in found)])),
                _array(*_strings(lot.data, lot.starts[here], lot.ends[ends])),
                pa.array(np.concatenate([np.empty(0, np.int64), *(x[2] for x in found)])),
            ],
            names=["lang", "size", "phrase", "n"],
        )

    return count


def chunk_dictionary(docs: DataFrame, lang_column: str = "lang", text_column: str = "text", period: int = PERIOD) -> DataFrame:
    """``(lang, chunk, n)``: the distinct chunks of a corpus, as ``parse`` gives them, and their frequency."""
    rows = docs.select(
        F.coalesce(F.col(lang_column).cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    )
    parsed = rows.mapInArrow(_parsed(period), "lang string, chunk string")
    return parsed.groupBy("lang", "chunk").agg(F.count("*").alias("n"))


def frequent_ngrams(chunks: DataFrame, least: int = LEAST) -> DataFrame:
    """``(lang, size, phrase, n)``: exact counts of n-grams that occur ``least`` times or more.

    ``chunks`` is read twice.
    """
    hashed = chunks.mapInArrow(_runs(_hashed), "hash bigint, n bigint")
    often = hashed.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("hash")
    spelled = _runs(_spelled(bitmap(stored(often, "often"), SPARSE)))
    counted = chunks.mapInArrow(spelled, "lang string, size int, phrase string, n bigint")
    return counted.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _cuts(phrases: DataFrame) -> DataFrame:
    """``(lang, phrase, size, a, k, head, rest)`` of every way to cut a phrase in two."""
    said = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    return phrases.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), cut).select(
        "lang", "phrase", "size", "a", "k",
        F.array_join(F.slice(said, 1, F.col("k")), " ").alias("head"),
        F.array_join(F.slice(said, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"),
    )


def collocations(
    docs: DataFrame,
    lang_column: str = "lang",
    text_column: str = "text",
    least: int = LEAST,
    top: int = TOP,
    period: int = PERIOD,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases of two or three words.

    A NULL language is ``und`` and a NULL text empty. Ties are settled by occurrences, then by the
    phrase in UTF-8 byte order, so a run always gives the same rows. Repeated rows count each time.
    Texts are read whole; a piece without any trigger is one chunk. Other columns are not read.
    """
    chunks = stored(chunk_dictionary(docs, lang_column, text_column, period), "chunks")
    overlap = F.when(F.endswith("chunk", F.lit(chr(OPEN))), F.lit(LONGEST - 1)).otherwise(F.lit(0))
    said = F.length("chunk") - F.length(F.replace("chunk", F.lit(" "), F.lit(""))) + 1 - overlap
    sizes = chunks.groupBy("lang").agg(F.sum(F.col("n") * said).alias("words"))
    grams = stored(frequent_ngrams(chunks, least), "ngrams")
    part = lambda name, as_: grams.select("lang", F.col("phrase").alias(name), F.col("n").alias(as_))
    cuts = _cuts(grams).join(part("head", "l"), ["lang", "head"]).join(part("rest", "r"), ["lang", "rest"])
    # products of counts pass 64 bits
    score = f"({SCALE}BD * cast(a AS decimal(16,0)) * a) div (cast(l AS decimal(19,0)) * r)"
    cuts = cuts.withColumn("score", F.expr(score))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "size")).alias("cut"))
    best = best.select("lang", "phrase", "cut.*")
    longer = grams.where(F.col("size") == LONGEST).select("lang", F.split("phrase", " ").alias("said"), F.col("n").alias("longer"))
    within = longer.select(
        "lang", "longer", F.explode(F.array(F.array_join(F.slice("said", 1, 2), " "), F.array_join(F.slice("said", 2, 2), " "))).alias("phrase")
    ).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    free = best.join(within, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < INSIDE * F.col("a"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = free.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score"
    )


def op11_prefix_free_phrases(spark, sf_dir):
    """The first 2000 phrases of every language."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
said AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces),
ones AS (SELECT lang, unnest(words) AS phrase FROM said),
totals AS (SELECT lang, count(*) AS n FROM ones GROUP BY lang),
grams AS (
  SELECT lang, 1 AS size, phrase FROM ones
  UNION ALL
  SELECT lang, 2, array_to_string(words[i : i + 1], ' ') FROM (
    SELECT lang, words, unnest(range(1, len(words))) AS i FROM said)
  UNION ALL
  SELECT lang, 3, array_to_string(words[i : i + 2], ' ') FROM (
    SELECT lang, words, unnest(range(1, len(words) - 1)) AS i FROM said)),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT lang, phrase, size, f AS a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS head,
         array_to_string(string_split(phrase, ' ')[k + 1 : size], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM counts WHERE size > 1)),
scored AS (
  SELECT c.lang, c.phrase, c.size, c.a, c.k, h.f AS l, t.f AS r,
         (1000000::HUGEINT * c.a * c.a) // (h.f::HUGEINT * t.f) AS score
  FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = c.head
  JOIN counts t ON t.lang = c.lang AND t.phrase = c.rest),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM scored)
  WHERE nth = 1),
within AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, f, array_to_string(string_split(phrase, ' ')[1 : 2], ' ') AS phrase FROM counts WHERE size = 3
    UNION ALL
    SELECT lang, f, array_to_string(string_split(phrase, ' ')[2 : 3], ' ') FROM counts WHERE size = 3)
  GROUP BY lang, phrase),
ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN within w ON w.lang = b.lang AND w.phrase = b.phrase AND b.size = 2
  WHERE w.longer IS NULL OR 100 * w.longer < 50 * b.a)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, CAST(r.score AS BIGINT) AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
