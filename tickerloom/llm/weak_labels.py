"""Quality classification from weak labels.

Overlapping heuristics ("labellers") vote good, bad or nothing on every document. A label model
is fitted by expectation-maximisation: each labeller's accuracy when it votes, and the share of
good documents; an abstention says nothing. It needs no more than the number of documents with
each combination of votes, of which there are at most 3 to the power of the labellers, counted
over all documents in Spark.

The posterior of each combination is the label with which a linear scorer over hashed features
is trained: words and their shapes, by logistic loss. It is fitted on at most about ``FIT_ROWS``
documents, chosen by a hash of the text, and then scores every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import table

GOOD, BAD, NONE = "g", "b", "-"
SYMBOLS = "#*$%&|<>"
SYMBOL_SET = frozenset(SYMBOLS)
#: For each bit of a word's kind, the kinds that have it.
KIND_BITS = [[k for k in range(16) if k >> b & 1] for b in range(4)]
#: Rounds of expectation-maximisation, where accuracies begin, and their bounds: labellers are
#: taken to be better than chance, which settles which class is the good one.
EM_ROUNDS, START, ACCURACY = 50, 0.8, (0.6, 0.99)
LABELLERS = 10
SLOTS = 1 << 16
FIT_ROWS, EPOCHS, RATE = 10_000, 5, 0.5
#: Distinct words that a task remembers.
KNOWN_WORDS = 1 << 18


def _clean(word: str) -> bool:
    """A word of letters, not all capitals, perhaps with punctuation around it."""
    bare = word.strip(".,;:?!'\"()-")
    return bare.isalpha() and not (bare.isupper() and len(bare) > 1)


class _Kinds(dict):
    """What is to be known of a word, in bits: clean, with a symbol, capitals, ends a sentence."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        symbol = not SYMBOL_SET.isdisjoint(word)
        self[word] = kind = _clean(word) + 2 * symbol + 4 * word.isupper() + 8 * (word[-1] in ".?!")
        return kind


_KINDS = _Kinds()


def votes(text: str) -> str:
    """One letter for each labeller."""
    found = text.split()
    n = len(found)
    if not n:
        return BAD * LABELLERS
    chars = sum(map(len, found))
    times = Counter(found)
    kinds = np.bincount(np.fromiter(map(_KINDS.__getitem__, found), np.int64, n), minlength=16)
    clean, with_symbol, capital, ends = (int(kinds[bits].sum()) for bits in KIND_BITS)
    clean, ends = clean / n, ends / n
    again = sum(map(eq, found, found[1:]))
    plain = clean >= 0.9 and again < 0.1 * n
    bad = [
        sum(map(text.count, SYMBOLS)) >= 0.05 * chars,
        with_symbol >= 0.2 * n,
        capital >= 0.4 * n,
        text.count("!") >= 0.2 * n,
        n >= 30 and len(times) <= 0.15 * n,
        n >= 30 and max(times.values()) >= 0.2 * n,
        n >= 10 and again >= 0.3 * n,
        n < 5,
    ]
    return "".join(BAD if b else NONE for b in bad) + (
        (GOOD if plain else BAD if clean <= 0.5 else NONE)
        + (GOOD if n >= 30 and again < 0.1 * n and 1 / 40 <= ends <= 1 / 3 else NONE)
    )


def fit_labellers(patterns: dict[str, int]) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior of good for each combination of votes; accuracies; share of good documents."""
    if not patterns:
        return {}, np.full(LABELLERS, START), 0.5
    names = sorted(patterns)
    n = np.array([patterns[p] for p in names], float)
    cast = np.array([[(c == GOOD) - (c == BAD) for c in p] for p in names], float)
    accuracy, prior = np.full(cast.shape[1], START), 0.5
    for _ in range(EM_ROUNDS):
        odds = np.log(prior / (1 - prior)) + cast @ np.log(accuracy / (1 - accuracy))
        good = 1 / (1 + np.exp(-odds))
        agreed = np.where(cast > 0, good[:, None], 1 - good[:, None]) * (cast != 0)
        weight = n @ (cast != 0)
        accuracy = np.clip((n @ agreed + START) / (weight + 1), *ACCURACY)
        prior = (n @ good + 1) / (n.sum() + 2)
    return dict(zip(names, good.tolist(), strict=True)), accuracy, prior


class _Classes(dict):
    """For str.translate: capitals as A, other letters as a, digits as 0, the rest as it is."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return self[code]


_CLASSES = _Classes()


def _shape(classes: str) -> str:
    """The classes of a word's characters with runs shortened."""
    return re.sub(r"(.)\1+", r"\1\1", classes)[:12]


def _slot(text: str) -> int:
    return xxhash.xxh32_intdigest(text.encode("utf-8", "replace")) % SLOTS


class _Slots(dict):
    """The two slots of a word; forgets all when full. Shapes are few and worked out once."""

    def __init__(self) -> None:
        super().__init__()
        self.shapes: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
            self.shapes.clear()
        classes = word.translate(_CLASSES)
        if (shape := self.shapes.get(classes)) is None:
            self.shapes[classes] = shape = _slot("s" + _shape(classes))
        self[word] = both = _slot("w" + word.lower()) * SLOTS + shape
        return both


def features(text: str, known: _Slots) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights: 1 + ln of the occurrences, of length one."""
    found = text.split()
    both = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
    slots, times = np.unique(np.concatenate([both // SLOTS, both % SLOTS]), return_counts=True)
    weight = 1 + np.log(times)
    return slots, weight / np.sqrt((weight**2).sum() or 1)


def train_scorer(texts: list[str], labels: list[float]) -> np.ndarray:
    """Weights of the slots and, last, the bias: AdaGrad on logistic loss, in a fixed order."""
    known = _Slots()
    rows = [features(t, known) for t in texts]
    weights, seen = np.zeros(SLOTS + 1), np.full(SLOTS + 1, 1e-6)
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)).tolist():
            slots, x = rows[i]
            error = 1 / (1 + np.exp(-(weights[slots] @ x + weights[-1]))) - labels[i]
            seen[slots] += (error * x) ** 2
            weights[slots] -= RATE * error * x / np.sqrt(seen[slots])
            seen[-1] += error**2
            weights[-1] -= RATE * error / np.sqrt(seen[-1])
    return weights


def classify(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", fit_rows: int = FIT_ROWS
) -> DataFrame:
    """``(doc_id, votes, posterior, score, kept)``: one row per row of ``docs``.

    ``posterior`` is the label model's chance of good quality, ``score`` the linear scorer's, and
    ``kept`` whether their mean is 0.5 or more. NULL texts count as empty; texts without words
    get the votes of the worst. Equal texts get equal rows. Other columns are not read.
    """
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cast = [votes(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(cast, pa.string())], names=["votes"])

    patterns = rows.select("text").mapInArrow(vote, "votes string").groupBy("votes").count()
    counted = {r.votes: r["count"] for r in patterns.collect()}  # at most 3^10 rows
    posterior, _, prior = fit_labellers(counted)
    share = min(1.0, fit_rows / max(1, sum(counted.values())))

    def train(key: tuple, found: pa.Table) -> pa.Table:
        texts = sorted(found.column("text").to_pylist())
        weights = train_scorer(texts, [posterior.get(votes(t), prior) for t in texts])
        return pa.table({"weights": [weights.tolist()]})

    chosen = rows.select("text").where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.lit(share * (1 << 30)))
    sample = chosen.distinct().withColumn("all", F.lit(1))
    fitted = sample.groupBy("all").applyInArrow(train, "weights array<double>").first()
    weights = np.array(fitted.weights) if fitted else np.zeros(SLOTS + 1)
    shared = docs.sparkSession.sparkContext.broadcast((posterior, weights))  # 3^10 and SLOTS numbers

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chances, learned = shared.value
        known = _Slots()
        for batch in batches:
            cast, scores = [], []
            for text in batch.column(1):
                text = text.as_py()
                slots, x = features(text, known)
                cast.append(votes(text))
                scores.append(1 / (1 + np.exp(-(learned[slots] @ x + learned[-1]))))
            believed = np.array([chances.get(c, prior) for c in cast], float)
            scores = np.array(scores, float)
            found = [pa.array(cast, pa.string()), *map(pa.array, (believed, scores, believed + scores >= 1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *found], names=["doc_id", "votes", "posterior", "score", "kept"]
            )

    return rows.mapInArrow(judge, f"doc_id {kind}, votes string, posterior double, score double, kept boolean")


def op7_weak_label_quality(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"))
