"""Company filings: the ticker-to-CIK map and the facts inside JSON documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom import schemas
from tickerloom.functions.text import pad_cik

CIK_MAP_JSON = "MAP<STRING, STRUCT<cik_str: STRING, ticker: STRING>>"

#: A company's number in the name of its document.
FILE_NAME = "(?i)cik0*([0-9]+)[^/]*$"
#: Where the parser puts text it cannot read.
BROKEN = "_broken"
ENTRY = "STRUCT<end: STRING, filed: STRING, form: STRING, val: DOUBLE>"
UNITS = f"STRUCT<units: MAP<STRING, ARRAY<{ENTRY}>>>"
FACTS_JSON = f"STRUCT<cik: STRING, facts: MAP<STRING, MAP<STRING, {UNITS}>>>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file: its path as ``doc`` and its text as ``json``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("doc"), F.col("value").alias("json")
    )


def cik_dimension(documents: DataFrame) -> DataFrame:
    """Ticker and ten-character CIK; the last entry of a ticker wins.

    Entries count in the order of ``doc``, then in their order within the document. The
    winner is an aggregate, so repeated tickers shrink before the shuffle.
    """
    entries = documents.select(
        "doc",
        F.posexplode(F.map_entries(F.from_json("json", CIK_MAP_JSON))).alias(
            "pos", "entry"
        ),
    )
    latest = F.max_by("entry.value.cik_str", F.struct("doc", "pos"))
    return (
        entries.where("entry.value.ticker is not null")
        .groupBy(F.upper("entry.value.ticker").alias("ticker"))
        .agg(pad_cik(latest).alias("cik"))
    )


def flatten_facts(
    documents: DataFrame,
    taxonomy: str | None = None,
    concepts: Sequence[str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Long facts table from JSON documents, one row per reported value.

    ``cik`` is the document's own number, or the one in its file name, in ten characters.
    Documents that cannot be read have no facts; ``unparsed_documents`` lists them.

    With ``taxonomy`` and ``concepts`` the parse schema names just those, so the JSON
    reader skips everything else. ``keep`` columns pass through. ``pos`` is the place of
    the value within its unit's array, which later breaks ties between filings.
    """
    if concepts is None:
        rows = _explode_all(documents, keep)
        if taxonomy is not None:
            rows = rows.where(F.col("taxonomy") == taxonomy)
    else:
        rows = _explode_named(documents, taxonomy or "us-gaap", concepts, keep)
    by_unit = rows.select(
        "cik", *keep, "taxonomy", "concept", F.explode("units").alias("unit", "entries")
    )
    return by_unit.select(
        "cik",
        *keep,
        "taxonomy",
        "concept",
        "unit",
        F.posexplode("entries").alias("pos", "entry"),
    ).select(
        "cik",
        *keep,
        "taxonomy",
        "concept",
        "unit",
        F.col("pos").cast("bigint").alias("pos"),
        "entry.end",
        "entry.filed",
        "entry.form",
        "entry.val",
    )


def _company(parsed: str) -> Column:
    """The padded number inside a parsed document, or else in its name."""
    named = F.nullif(F.regexp_extract(F.col("doc").cast("string"), FILE_NAME, 1), F.lit(""))
    return pad_cik(F.coalesce(F.col(f"{parsed}.cik"), named)).alias("cik")


def unparsed_documents(documents: DataFrame) -> DataFrame:
    """``(doc, reason)`` of documents that give no facts.

    ``empty``: no text; ``malformed``: no complete JSON; ``no_facts``: JSON without facts;
    ``no_cik``: facts of no known company.
    """
    schema = FACTS_JSON.removesuffix(">") + f", {BROKEN}: STRING>"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
    parsed = documents.select("doc", "json", F.from_json("json", schema, options).alias("parsed"))
    reason = (
        F.when(F.coalesce(F.trim("json"), F.lit("")) == "", "empty")
        .when(F.col("parsed").isNull() | F.col(f"parsed.{BROKEN}").isNotNull(), "malformed")
        .when(F.col("parsed.facts").isNull(), "no_facts")
        .when(_company("parsed").isNull(), "no_cik")
    )
    return parsed.select("doc", reason.alias("reason")).where(F.col("reason").isNotNull())


def facts_and_faults(documents: DataFrame) -> DataFrame:
    """Facts as ``flatten_facts`` gives them, and the documents without any, from one parse.

    Columns are ``doc``, those of the facts, and ``reason``, which is NULL in facts and, in a row
    without a fact, says why its document has none. Documents become VARIANT values once, which are
    then taken apart level by level; nothing about taxonomies, concepts or units need be known.
    """
    spark = documents.sparkSession
    tvf = spark.tvf
    parsed = documents.select("doc", "json", F.try_parse_json("json").alias("v"))
    named = F.nullif(F.regexp_extract(F.col("doc").cast("string"), FILE_NAME, 1), F.lit(""))
    opened = parsed.select(
        "doc",
        pad_cik(F.coalesce(F.try_variant_get("v", "$.cik", "string"), named)).alias("cik"),
        F.try_variant_get("v", "$.facts", "variant").alias("facts"),
        F.when(F.coalesce(F.trim("json"), F.lit("")) == "", "empty")
        .when(F.col("v").isNull(), "malformed")
        .when(F.try_variant_get("v", "$.facts", "map<string, variant>").isNull(), "no_facts")
        .alias("fault"),
    )
    faults = F.coalesce("fault", F.when(F.col("cik").isNull(), "no_cik"))
    opened = opened.withColumn("reason", faults)

    def taken_apart(rows: DataFrame, value: str, names: list[str], outer: bool = False) -> DataFrame:
        apart = tvf.variant_explode_outer if outer else tvf.variant_explode
        found = apart(F.col(value).outer())
        return rows.lateralJoin(found.toDF(*names))

    # a faulty document keeps one row, without a fact
    readable = F.when(F.col("reason").isNull() | (F.col("reason") == "no_cik"), F.col("facts"))
    rows = taken_apart(opened.withColumn("facts", readable), "facts", ["p1", "taxonomy", "concepts"], outer=True)
    rows = taken_apart(rows, "concepts", ["p2", "concept", "body"], outer=True)
    rows = rows.withColumn("units", F.try_variant_get("body", "$.units", "variant"))
    rows = taken_apart(rows, "units", ["p3", "unit", "entries"], outer=True)
    rows = taken_apart(rows, "entries", ["pos", "k", "entry"], outer=True)
    text = lambda name: F.try_variant_get("entry", f"$.{name}", "string").alias(name)
    return rows.select(
        "doc", "cik", "taxonomy", "concept", "unit", F.col("pos").cast("bigint").alias("pos"),
        text("end"), text("filed"), text("form"), F.try_variant_get("entry", "$.val", "double").alias("val"), "reason",
    ).where(F.col("pos").isNotNull() | F.col("reason").isNotNull())


def write_facts(facts: DataFrame, path: str, mode: str = "error") -> None:
    """Store facts sorted by company, so that file statistics prune to the companies read.

    The range includes the concept and the period: one company's facts may span files.
    """
    order = ["cik", "taxonomy", "concept", "end"]
    columns = schemas.FACTS.fieldNames()
    sorted_rows = facts.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows.write.mode(mode).parquet(path)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FACTS).parquet(path)


def _others(keep: Sequence[str]) -> list[str]:
    return [name for name in keep if name != "doc"]


def _explode_all(documents: DataFrame, keep: Sequence[str]) -> DataFrame:
    parsed = documents.select("doc", *_others(keep), F.from_json("json", FACTS_JSON).alias("parsed"))
    by_taxonomy = parsed.select(
        _company("parsed"), *keep, F.explode("parsed.facts").alias("taxonomy", "concepts")
    )
    by_concept = by_taxonomy.select(
        "cik", *keep, "taxonomy", F.explode("concepts").alias("concept", "body")
    )
    return by_concept.select("cik", *keep, "taxonomy", "concept", "body.units")


def _explode_named(
    documents: DataFrame, taxonomy: str, concepts: Sequence[str], keep: Sequence[str]
) -> DataFrame:
    fields = ", ".join(f"`{name}`: {UNITS}" for name in concepts)
    schema = f"STRUCT<cik: STRING, facts: STRUCT<`{taxonomy}`: STRUCT<{fields}>>>"
    document = documents.select("doc", *_others(keep), F.from_json("json", schema).alias("parsed"))
    parsed = document.select(
        _company("parsed"), *keep, F.col("parsed.facts")[taxonomy].alias("named")
    )
    pairs = F.array(
        *[
            F.struct(
                F.lit(name).alias("concept"),
                F.col("named").getField(name).getField("units").alias("units"),
            )
            for name in concepts
        ]
    )
    by_concept = parsed.select("cik", *keep, F.explode(pairs).alias("pair"))
    return by_concept.select(
        "cik", *keep, F.lit(taxonomy).alias("taxonomy"), "pair.concept", "pair.units"
    )
