"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its words, each with its number of occurrences. For a word of weight
w, the word's hash yields r and c from Gamma(2, 1) and b from U(0, 1), and

    t = floor(ln w / r + b),   ln y = r (t - b),   ln a = ln c - ln y - r.

The word with the least a, together with its t, is the sample. Over texts with weights w and w',
the chance that both samples agree is sum(min(w, w')) / sum(max(w, w')), the generalised Jaccard
similarity. Terms are dealt by their hash to ``BINS`` bins with one sample each, so each is drawn
for once, whatever the number of samples. A frequent word would count in its own bin alone; so a
word's weight is cut into terms (word, 0), (word, 1), ... of ``UNIT`` occurrences and a rest,
which leaves the sums of least and greatest weights as they are and spreads it over the bins. The
likeness of two fingerprints is the share of equal samples among the bins that either text has
terms in; bins that both leave empty say nothing, which keeps it right for short texts.

Everything is inside the row: hash, sort, count and pick with array functions of the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.llm.common import table, words

BINS = 128
#: Occurrences of a word that one term takes.
UNIT = 2
#: ln a is kept in steps of 2^-30 within +-512, in 40 bits; a sample has 16 bits.
SCALE = 1 << 30
REACH = 512


def _unit(bits: Column, shift: int) -> Column:
    """32 bits of a hash, from ``shift`` on, as a number strictly between 0 and 1."""
    part = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << 32) - 1))
    return (part.cast("double") + F.lit(0.5)) / F.lit(float(1 << 32))


def _packed_sample(term: Column, weight: Column) -> Column:
    """Bin, ln a and sample of a term in one BIGINT that sorts by bin and ln a."""
    one, two, three = (F.xxhash64(term, F.lit(k)) for k in (1, 2, 3))
    drawn = F.struct(
        (-F.log(_unit(one, 0) * _unit(one, 32))).alias("r"),
        F.log(-F.log(_unit(two, 0) * _unit(two, 32))).alias("c"),
        _unit(three, 0).alias("b"),
        term.alias("h"),
        F.log(weight.cast("double")).alias("w"),
    )
    def level(d: Column) -> Column:
        return F.struct(
            F.floor(d["w"] / d["r"] + d["b"]).alias("t"),
            d["r"].alias("r"), d["c"].alias("c"), d["b"].alias("b"), d["h"].alias("h"),
        )

    def pack(d: Column) -> Column:
        a = d["c"] - d["r"] * (d["t"].cast("double") - d["b"]) - d["r"]
        place = F.greatest(F.lit(0.0), F.least((a + REACH) * SCALE, F.lit(float((1 << 40) - 1))))
        return (
            F.shiftleft(d["h"].bitwiseAND(F.lit(BINS - 1)), 56)
            .bitwiseOR(F.shiftleft(F.floor(place), 16))
            .bitwiseOR(F.xxhash64(d["h"], d["t"]).bitwiseAND(F.lit(0xFFFF)))
        )

    # an array of one binds a name to what is used several times
    return F.get(F.transform(F.transform(F.array(drawn), level), pack), F.lit(0))


def _run_starts(ordered: Column) -> Column:
    """Positions in a sorted array at which a new value begins."""
    marked = F.transform(
        ordered,
        lambda h, i: F.when((i == 0) | (F.get(ordered, i - 1) != h), i).otherwise(-1),
    )
    return F.filter(marked, lambda i: i >= 0)


def _samples_of_runs(ordered: Column, starts: Column) -> Column:
    """Packed samples of the terms of the words in a sorted array."""

    def of_word(p: Column, j: Column) -> Column:
        count = F.coalesce(F.get(starts, j + 1), F.size(ordered)) - p
        whole = F.floor((count - 1) / UNIT).cast("int")
        return F.transform(
            F.sequence(F.lit(0), whole),
            lambda k: _packed_sample(
                F.xxhash64(F.get(ordered, p), k), F.least(count - k * UNIT, F.lit(UNIT))
            ),
        )

    return F.flatten(F.transform(starts, of_word))


def _least_of_bins(packed: Column) -> Column:
    """Of sorted packed samples the first of each bin, as bin * 65536 + 16 bits of the sample."""
    least = F.filter(
        packed,
        lambda x, i: (i == 0) | (F.shiftright(F.get(packed, i - 1), 56) != F.shiftright(x, 56)),
    )
    return F.transform(
        least, lambda x: (F.shiftright(x, 56) * 65536 + x.bitwiseAND(F.lit(0xFFFF))).cast("int")
    )


def with_samples(rows: DataFrame, text_columns: dict[str, str]) -> DataFrame:
    """``rows`` with an array of samples for each ``{new column: text column}``.

    Empty texts have none. The steps are columns of their own, each used more than once by the
    next, so that none is worked out again for every element.
    """
    for new, text in text_columns.items():
        hashes = F.transform(words(F.col(text)), lambda w: F.xxhash64(w))
        rows = rows.withColumn("_ordered", F.sort_array(hashes))
        rows = rows.withColumn("_starts", _run_starts(F.col("_ordered")))
        packed = _samples_of_runs(F.col("_ordered"), F.col("_starts"))
        rows = rows.withColumn("_packed", F.sort_array(packed)).drop("_ordered", "_starts")
        rows = rows.withColumn(new, _least_of_bins(F.col("_packed"))).drop("_packed")
    return rows


def as_text(samples: Column) -> Column:
    """A fingerprint as text: six hex digits a sample, in the order of bins."""
    return F.lower(F.array_join(F.transform(samples, lambda x: F.lpad(F.hex(x), 6, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated generalised Jaccard similarity of two sample arrays; 1 for two empty ones."""
    bins = F.size(
        F.array_union(
            F.transform(a, lambda x: F.shiftright(x, 16)), F.transform(b, lambda x: F.shiftright(x, 16))
        )
    )
    return F.when(bins == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / bins)


def _boundaries(docs: DataFrame, parts: int) -> list[int]:
    """Ids, present in ``docs``, that cut it into about ``parts`` even ranges; the least first.

    Only these few numbers come to the driver; they are as many as there are ranges.
    """
    shares = [i / parts for i in range(1, parts)] or [0.5]
    row = docs.agg(F.min("doc_id"), F.percentile_approx("doc_id", shares, 100 * parts)).first()
    return [] if row[0] is None else sorted({row[0], *row[1]})


def _range_of(key: Column, bounds: list[int]) -> Column:
    """The last boundary at or below ``key``, by binary search over a literal array."""
    steps, size = [], 1
    while size < len(bounds):
        steps.append(size)
        size *= 2
    array = F.lit(bounds)
    return F.aggregate(
        F.array(*(F.lit(s) for s in reversed(steps))) if steps else F.array().cast("array<int>"),
        F.lit(0),
        lambda at, s: F.when(F.coalesce(F.get(array, at + s) <= key, F.lit(False)), at + s).otherwise(at),
    )


def beside_next(docs: DataFrame, parts: int) -> DataFrame:
    """``docs(doc_id, text)`` by ranges of ids, ready for a window: ``part, guest, doc_id, text``.

    The first document of every range visits the range before as its last row (``guest``), and
    the very first visits the last range, so that every document finds its successor within its
    own range: the text is shuffled once and no row order passes through a single task.
    """
    bounds = _boundaries(docs, parts)
    if not bounds:
        return docs.select(F.lit(0).alias("part"), F.lit(False).alias("guest"), "doc_id", "text")
    last = len(bounds) - 1
    home = F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(_range_of(F.col("doc_id"), bounds))
    rows = docs.select("doc_id", "text", home.alias("home"))
    visits = F.when(
        F.get(F.lit(bounds), F.col("home")) == F.col("doc_id"),
        F.when(F.col("home") == 0, F.lit(last)).otherwise(F.col("home") - 1),
    )
    places = F.array(
        F.struct(F.col("home").alias("part"), F.lit(False).alias("guest")),
        F.struct(visits.alias("part"), F.lit(True).alias("guest")),
    )
    return rows.select("doc_id", "text", F.explode(places).alias("p")).select(
        "p.part", "p.guest", "doc_id", "text"
    ).where("part is not null")


def compare_neighbours(
    docs: DataFrame, parts: int, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The next document is the one with the next id, after the last the first; rows with equal ids
    follow in the order of their texts' hashes, and rows without an id come last. If no row has an id,
    nothing follows. NULL texts count as empty. Other columns are not read.
    """
    named = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("part").orderBy("guest", F.asc_nulls_last("doc_id"), F.xxhash64("text"))
    rows = beside_next(named, parts).withColumn(
        "next_text", F.coalesce(F.lead("text").over(order), F.lit(""))
    )
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn(
        "edited",
        F.concat(
            F.substring("text", F.lit(1), F.length("text") - half),
            F.substring("next_text", F.lit(1), half),
        ),
    ).drop("next_text")
    rows = with_samples(rows, {"print": "text", "edited_print": "edited"})
    none = F.array().cast("array<int>")
    rows = rows.withColumn("next_print", F.coalesce(F.lead("print").over(order), none)).where("not guest")
    return rows.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )


def range_count(spark: SparkSession) -> int:
    """Four ranges for each shuffle partition, so that dealing them by hash stays even."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def op10_cws_fingerprints(spark, sf_dir):
    return compare_neighbours(table(spark, sf_dir, "documents"), range_count(spark))
