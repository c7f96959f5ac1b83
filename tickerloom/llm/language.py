"""Language identification by nearest centroids of TF-IDF n-gram vectors.

Lower-cased letters and word ends give character n-grams of one to three, hashed to ``SLOTS``
slots. A text's vector has (1 + ln count) * idf in each slot and length one. The vectors of a
language's texts are clustered, so that a language may have several kinds of text, and a text
takes the language of the centroid with the greatest cosine.

Document frequencies are counted over all labelled texts. Clusters are fitted on at most about
``FIT_ROWS`` labelled texts of a language, chosen by a hash of the text alone; the share kept is
the bound over that language's count. Half of a language's sample is held against clusters of the
other half; the low cosines of these held-out texts, of all languages and by the length of the
text, set the distance from which a text is rejected as none of the known languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import crc_fold, table

UNDETERMINED = "und"
SLOTS = 16384
CENTROIDS = 4
ROUNDS = 8
FIT_ROWS = 2000
#: A text is rejected below this share of the low cosine (the 1st percentile) of its length.
REJECT = 0.5
#: Bounds of lengths, in n-grams; a letter makes a little over three.
BANDS = (100, 350, 700, 1400, 2800, 5600, 22400)
#: Texts that are held as vectors at once, and characters that are hashed at once.
STEP = 128
CHARS = 1 << 20
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_SHIFT = np.uint64(64 - SLOTS.bit_length() + 1)


class _Table(dict):
    """For str.translate: other characters than letters to spaces, worked out once each."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        self[code] = char.lower()[0] if char.isalpha() else " "
        return self[code]


_PLAIN = _Table()


def counts(text: str) -> np.ndarray:
    """Occurrences of n-grams in each slot, over the whole text in stretches."""
    total = np.zeros(SLOTS, np.int64)
    for at in range(0, len(text), CHARS):
        # two characters of overlap complete the n-grams across the cut
        part = text[max(0, at - 2) : at + CHARS].translate(_PLAIN)
        lead = min(at, 2)
        codes = np.frombuffer(f" {part} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        codes = codes[1 if at else 0 : -1 if at + CHARS < len(text) else None]
        inside = codes != 32
        one, two, three = (codes * m for m in _MIX)
        pairs = two[:-1] ^ (one[1:] << np.uint64(1))
        keep = [one[lead:][inside[lead:]], pairs[max(0, lead - 1) :][(inside[:-1] | inside[1:])[max(0, lead - 1) :]]]
        keep.append(((three[:-2] ^ pairs[1:] * _MIX[0]))[inside[1:-1]])
        for grams in keep:
            grams = grams * _MIX[1]
            total += np.bincount((grams >> _SHIFT).astype(np.int64), minlength=SLOTS)
    return total


def vectors(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of some texts, zero for one without letters, and their bands of length."""
    found = np.zeros((len(texts), SLOTS), np.float32)
    for row, text in zip(found, texts, strict=True):
        row[:] = counts(text)
    bands = np.searchsorted(BANDS, found.sum(axis=1, dtype=np.float64), side="right")
    seen = found > 0
    found[seen] = 1 + np.log(found[seen])
    found *= idf
    length = np.linalg.norm(found, axis=1, keepdims=True)
    found /= np.where(length > 0, length, 1)
    return found, bands


@dataclass(frozen=True)
class Model:
    """Centroids with their languages, the least cosine of each band, and the idf of every slot."""

    languages: list[str]
    centroids: np.ndarray
    floors: np.ndarray
    idf: np.ndarray


def _clusters(points: np.ndarray, wanted: int) -> np.ndarray:
    """Spherical k-means from points far apart; ties go to the first."""
    centres = [points[0]]
    while len(centres) < min(wanted, len(points)):
        nearest = (points @ np.array(centres).T).max(axis=1)
        centres.append(points[int(nearest.argmin())])
    fitted = np.array(centres)
    for _ in range(ROUNDS):
        mine = (points @ fitted.T).argmax(axis=1)
        for k in range(len(fitted)):
            if (mine == k).any():
                mean = points[mine == k].mean(axis=0)
                fitted[k] = mean / max(np.linalg.norm(mean), 1e-12)
    return fitted


def _held_out(points: np.ndarray) -> np.ndarray:
    """The cosine of every point with the nearest cluster of the half it is not in."""
    low = np.zeros(len(points))
    if len(points) < 2:
        return low + 1
    for half in (0, 1):
        low[half::2] = (points[half::2] @ _clusters(points[1 - half :: 2], CENTROIDS).T).max(axis=1)
    return low


def _floors(bands: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """The least cosine of each band: never above that of a longer one, and that of the next
    shorter one where no text was held out."""
    floors = np.full(len(BANDS) + 1, np.nan)
    for band in np.unique(bands):
        floors[band] = REJECT * np.quantile(cosines[bands == band], 0.01)
    known = np.flatnonzero(~np.isnan(floors))
    if not len(known):
        return np.zeros(len(floors))
    for band in range(len(floors)):
        if np.isnan(floors[band]):
            floors[band] = floors[band - 1] if band > known[0] else floors[known[0]]
    return np.minimum.accumulate(floors[::-1])[::-1]


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model of ``labelled(text, lang)``; rows without either teach nothing.

    The document frequencies are summed over all rows in one pass, a row of ``SLOTS`` counts for
    each task. The sample is grouped by language: at most about ``fit_rows`` rows a group.
    """
    taught = labelled.select(F.col("text").cast("string"), F.col("lang").cast("string")).where(
        "text is not null and lang is not null"
    )

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                total += counts(text.as_py()) > 0
                n += 1
        slots = np.append(np.arange(SLOTS), -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(slots), pa.array(np.append(total, n))], names=["slot", "n"]
        )

    seen = taught.select("text").mapInArrow(frequencies, "slot bigint, n bigint")
    df = {r.slot: r.n for r in seen.groupBy("slot").agg(F.sum("n").alias("n")).collect()}
    rows = df.get(-1, 0) or 0
    frequency = np.array([df.get(i, 0) for i in range(SLOTS)], np.float64)
    idf = np.log((1 + rows) / (1 + frequency)).astype(np.float32) + np.float32(1)

    sizes = {r.lang: r.n for r in taught.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((0, SLOTS), np.float32), np.zeros(len(BANDS) + 1), idf)
    # places of the hash range that a language keeps; all of it where it has few rows
    share = F.coalesce(
        *(F.when(F.col("lang") == k, F.lit(min(1.0, fit_rows / n))) for k, n in sizes.items())
    )
    chosen = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share * (1 << 30)

    def cluster(key: tuple, found: pa.Table) -> pa.Table:
        # equal texts share a hash, so copies count once
        texts = sorted(set(found.column("text").to_pylist()))
        points, bands = vectors(texts, idf)
        some = points.any(axis=1)
        points, bands = points[some], bands[some]
        if not len(points):
            return pa.table({c: [] for c in out.names}, schema=out)
        centres = _clusters(points, CENTROIDS)
        # held-out cosines stand in the first row of a language only
        rest = [[]] * (len(centres) - 1)
        return pa.table(
            {
                "lang": [key[0].as_py()] * len(centres),
                "centroid": centres.tolist(),
                "bands": [bands.tolist(), *rest],
                "cosines": [_held_out(points).tolist(), *rest],
            },
            schema=out,
        )

    out = pa.schema(
        [
            ("lang", pa.string()),
            ("centroid", pa.list_(pa.float32())),
            ("bands", pa.list_(pa.int32())),
            ("cosines", pa.list_(pa.float64())),
        ]
    )
    sample = taught.where(chosen).distinct()
    fitted = sample.groupBy("lang").applyInArrow(cluster, "lang string, centroid array<float>, bands array<int>, cosines array<double>")
    found = sorted(fitted.collect(), key=lambda r: (r.lang, r.centroid))
    return Model(
        [r.lang for r in found],
        np.array([r.centroid for r in found], np.float32).reshape(-1, SLOTS),
        _floors(
            np.array([x for r in found for x in r.bands], int), np.array([x for r in found for x in r.cosines])
        ),
        idf,
    )


def predict(docs: DataFrame, model: Model, keep: list[str], text_column: str = "text") -> DataFrame:
    """``keep`` with ``lang_pred, score, rejected`` for every row.

    A NULL text, one without letters, or a model without languages gives ``und``, 0 and
    rejection. Elsewhere ``lang_pred`` is the nearest language even if the text is rejected.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CENTROIDS rows a language, one of idf

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
                points, bands = vectors(texts, known.idf)
                blank = ~points.any(axis=1)
                if known.languages:
                    cosines = points @ known.centroids.T
                    best = cosines.argmax(axis=1)
                    score = np.clip(cosines.max(axis=1), 0, 1).astype(np.float64)
                    names = [UNDETERMINED if b else known.languages[k] for b, k in zip(blank, best, strict=True)]
                    rejected = blank | (score < known.floors[bands])
                else:
                    names, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                    rejected = np.ones(len(texts), bool)
                score[blank] = 0
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(names), pa.array(score), pa.array(rejected)],
                    names=[*keep, "lang_pred", "score", "rejected"],
                )

    rows = docs.select(*keep, F.col(text_column).cast("string").alias("_text"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(judge, f"{schema}, lang_pred string, score double, rejected boolean")


def op8_centroid_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_fold(F.col("doc_id"), 3) == 1, F.lit(False))
    model = fit(docs.where(~held_out))
    return predict(docs, model, ["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected"
    )


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose text is not rejected, with the predicted language in ``lang``.

    The model learns from the languages the documents come with.
    """
    whole = docs.select(F.struct("*").alias("row"), "text")
    judged = predict(whole, fit(docs), ["row"]).where("not rejected")
    names = {c: "lang_pred" if c == "lang" else f"row.`{c}`" for c in docs.columns}
    return judged.select(*(F.col(place).alias(c) for c, place in names.items()))
