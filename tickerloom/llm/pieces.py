"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is marked: a space in front, and every space as U+2581. Pieces never have a mark after
another character, so the best segmentation of a text is that of its marked words one by one: a
run of marks and what follows it up to the next mark. Each batch of texts is reduced to its
distinct marked words, which are sorted; walking them in that order visits their trie depth
first, and the forward scores of the prefix that a word shares with the one before are used
again. What is worked out for a word serves all its occurrences.

The best segmentation has the greatest sum of the vocabulary's piece scores; of equal ones the
one whose last piece is the longest, from the end on. A character that no piece covers is worth
less than any piece and becomes the pieces of its UTF-8 bytes.

This is the segmentation that unigram models define. For vocabularies that were made by merging
pairs it finds the best-scoring segmentation into the same pieces, which need not be the one that
repeating the merges gives; both decode to the same text. A text's own U+2581 decodes as a space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words whose pieces a worker remembers; texts handled at once.
KNOWN_WORDS = 300_000
STEP = 512
#: Kinds of pieces in a vocabulary file.
NORMAL, BYTE = 1, 6
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Vocabulary:
    """Pieces, scores and byte pieces of a vocabulary file."""

    def __init__(self, data: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        model.ParseFromString(data)
        self.pieces = [p.piece for p in model.pieces]
        usable = [(i, p) for i, p in enumerate(model.pieces) if p.type == NORMAL]
        self.scored = {p.piece: (p.score, i) for i, p in usable}
        #: What a piece can end with, so that a search backwards knows when to stop.
        self.endings = dict.fromkeys(p.piece[k:] for _, p in usable for k in range(len(p.piece)))
        self.endings.update(self.scored)
        self.unknown = min(p.score for _, p in usable) - 10
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        #: Pieces as they stand in a text, in UTF-8.
        whole = [p.piece.replace(MARK, " ").encode("utf-8") for p in model.pieces]
        single = [bytes([self.byte_of[i]]) if i in self.byte_of else w for i, w in enumerate(whole)]
        self.shown = pa.array(single, pa.binary())


class Encoder:
    """Segments words, remembering those it has seen."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.known: dict[str, list[int]] = {}

    def learn(self, words: set[str]) -> int:
        """Segment words; the number of characters whose forward scores were worked out."""
        look, unknown, nothing = self.vocabulary.endings.get, self.vocabulary.unknown, (0.0, -2)
        best, back = [0.0], [(0, -1)]
        before, steps = "", 0
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                found = look(word[end - 1], nothing)
                if found is None or found is nothing:
                    top, at, piece = best[end - 1] + unknown, end - 1, -1
                else:
                    top, at, piece = best[end - 1] + found[0], end - 1, found[1]
                if found is not nothing:
                    # from short to long: of equal sums the longest last piece stays
                    for begin in range(end - 2, -1, -1):
                        found = look(word[begin:end], nothing)
                        if found is None:
                            continue
                        if found is nothing:
                            break
                        score = best[begin] + found[0]
                        if score >= top:
                            top, at, piece = score, begin, found[1]
                best.append(top)
                back.append((at, piece))
            steps += len(word) - shared
            before = word
            self.known[word] = self._trace(word, back)
        return steps

    def _trace(self, word: str, back: list[tuple[int, int]]) -> list[int]:
        ids: list[int] = []
        end = len(word)
        while end:
            begin, piece = back[end]
            if piece >= 0:
                ids.append(piece)
            else:
                ids += [self.vocabulary.bytes[b] for b in reversed(word[begin:end].encode("utf-8"))]
            end = begin
        return ids[::-1]

    def encode(self, texts: list[str]) -> list[list[int]]:
        marked = [_WORD.findall(f"{MARK}{t.replace(' ', MARK)}") if t else [] for t in texts]
        distinct = set().union(*marked)
        if len(self.known) + len(distinct) > KNOWN_WORDS:
            self.known.clear()
        self.learn(distinct - self.known.keys())
        known = self.known
        return [list(chain.from_iterable(map(known.__getitem__, found))) for found in marked]


def decoded(lists: pa.ListArray, vocabulary: Vocabulary) -> list[str | None]:
    """The texts of sequences of pieces; bytes that are no UTF-8 become U+FFFD."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    bounds = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    parts = pa.ListArray.from_arrays(bounds, vocabulary.shown.take(lists.flatten()))
    whole = pc.binary_join(parts, pa.scalar(b"")).to_pylist()
    texts = [w.decode("utf-8", "replace").removeprefix(" ") for w in whole]
    return [t if v else None for t, v in zip(texts, lists.is_valid().to_pylist(), strict=True)]


@lru_cache(maxsize=2)
def _encoder(data: bytes) -> Encoder:
    """One for all tasks of a worker, with the words it knows."""
    return Encoder(Vocabulary(data))


def _vocabulary_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, keep: list[str], text_column: str = "text", model: str = MODEL) -> DataFrame:
    """``keep`` with ``ids``, the pieces of the text; NULL and empty texts have none.

    The vocabulary file is read by the driver and sent to the workers: some hundred kilobytes,
    whatever the table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_vocabulary_bytes(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
                ids = pa.array(encoder.encode(texts), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names=[*keep, "ids"])

    rows = docs.select(*keep, F.col(text_column).cast("string").alias("_text"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{schema}, ids array<int>")


def decode(rows: DataFrame, keep: list[str], ids_column: str = "ids", model: str = MODEL) -> DataFrame:
    """``keep`` with ``text``, the text of the pieces; NULL for NULL."""
    shared = rows.sparkSession.sparkContext.broadcast(_vocabulary_bytes(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _encoder(shared.value).vocabulary
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                texts = decoded(part.column(part.num_columns - 1), vocabulary)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"]
                )

    chosen = rows.select(*keep, F.col(ids_column).alias("_ids"))
    schema = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep)
    return chosen.mapInArrow(run, f"{schema}, text string")


def _digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def op5_sentencepiece_viterbi(spark, sf_dir):
    """Pieces of every whole text: their number and digest, and whether they decode to the text."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text")
    )
    known = docs.withColumns(
        {"n_chars": F.length("text").cast("bigint"), "text_sha256": _digest(F.col("text"))}
    )
    coded = encode(known, ["doc_id", "n_chars", "text_sha256"])
    facts = coded.select(
        "doc_id", "n_chars", "text_sha256", "ids",
        F.size("ids").cast("bigint").alias("n_pieces"),
        _digest(F.array_join("ids", ",")).alias("ids_sha256"),
    )
    back = decode(facts, ["doc_id", "n_chars", "text_sha256", "n_pieces", "ids_sha256"])
    return back.select(
        "doc_id", "n_chars", "n_pieces", "ids_sha256",
        (_digest(F.col("text")) == F.col("text_sha256")).alias("round_trip"),
    )
