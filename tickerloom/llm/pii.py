"""Personal data: regular expressions propose, checksums confirm, nearby words weigh.

Each kind has a pattern, an optional validator and context words. Matches are leftmost and do
not overlap within a kind; one that its validator refuses is dropped and the search goes on after
it. A confirmed match starts with its kind's score and gains for a context word among the
``CONTEXT`` characters on either side, other matches among them; spans from ``THRESHOLD`` on are
reported.

All of it are array functions of the JVM. The places of matches come from the text between them:
the start of a match is the length of all pieces and matches before it. Sums over the matches of
a text are taken in blocks, so a text with very many matches costs a small multiple of their
number. The characters around a match are joined from as many neighbouring matches, and the pieces
between them, as ``CONTEXT`` characters can hold.

The patterns are written so that no text makes them slow. Where a match cannot begin inside a run
of its first characters, a look-behind keeps it from trying, and possessive quantifiers stand
where giving back characters cannot help; both leave the matches as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import table

CONTEXT = 40
CONTEXT_GAIN = 0.3
THRESHOLD = 0.6
#: Matches that are added up together.
BLOCK = 64


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. ``within`` is a cheap test of whole texts that cannot match, and
    no match is shorter than ``least``."""

    name: str
    pattern: str
    within: str
    least: int
    score: float
    words: list[str] = field(default_factory=list)


LOCAL = "[A-Za-z0-9._%+-]"
#: The base kinds, whose matches are always reported, in the order of reports.
BASE = [
    Kind(
        "email",
        # after a match, \G lets the next begin right behind it
        rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@",
        5,
        0.9,
        ["mail", "contact"],
    ),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 7, 0.6, ["ip", "host"]),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]", 2, 0.7, ["card", "visa", "credit"]),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 4, 0.6, ["phone", "call", "tel"]),
]
#: Further kinds. Those below the threshold need a context word.
ADDED = [
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        "[A-Z]{2}[0-9]{2}",
        12,
        0.7,
        ["iban", "account", "bank"],
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        "[0-9]-[0-9]",
        11,
        0.4,
        ["ssn", "social security"],
    ),
    Kind(
        "secret",
        r"(?<![A-Za-z0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])",
        "[0-9a-f]{32}",
        32,
        0.4,
        ["token", "key", "secret", "password"],
    ),
]
KINDS = [*BASE, *ADDED]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn test."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            (2 * d.cast("int")) % 10 + F.floor(2 * d.cast("int") / 10).cast("int")
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda total, d: total + d) % 10 == 0


def _mod_97(value: Column) -> Column:
    """Whether an account number leaves 1 modulo 97, its letters read as 10 to 35."""
    plain = F.regexp_replace(value, r"\x20", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + F.ascii(c) - 48) % 97).otherwise(
            (r * 100 + F.ascii(c) - 55) % 97
        ),
    )
    return rest == 1


def confirmed(kind: str, value: Column) -> Column:
    """Whether a match of a kind's pattern is one of that kind."""
    count = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.when(count.between(13, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return count.between(9, 15)
    if kind == "iban":
        return F.when(F.length(F.regexp_replace(value, r"\x20", "")).between(15, 34), _mod_97(value)).otherwise(False)
    return F.lit(True)


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda total, n: total + n)


def _with_matches(rows: DataFrame, kind: Kind) -> DataFrame:
    """``rows(_text, ...)`` with ``_<kind>``: an array of (start, value, around) of the pattern's
    matches that are confirmed."""
    within = F.col("_text").rlike(kind.within)
    pattern = F.lit(kind.pattern)
    found = F.regexp_extract_all("_text", pattern, 0)
    nothing = F.array().cast("array<string>")
    rows = rows.withColumn("_m", F.when(within, found).otherwise(nothing))
    pieces = F.split("_text", pattern, -1)
    rows = rows.withColumn("_b", F.when(F.size("_m") > 0, pieces).otherwise(nothing))
    before = F.transform("_b", lambda piece: F.length(piece))
    steps = F.transform("_m", lambda m, i: F.length(m) + F.length(F.get("_b", i)))
    rows = rows.withColumns({"_before": before, "_steps": steps})
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("_steps") / BLOCK).cast("int")),
        lambda b: _total(F.slice("_steps", b * BLOCK + 1, F.lit(BLOCK))),
    )
    rows = rows.withColumn("_blocks", blocks)
    start = lambda i: (
        _total(F.slice("_blocks", F.lit(1), F.floor(i / BLOCK).cast("int")))
        + _total(F.slice("_steps", F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))
        + F.get("_before", i)
    )
    placed = F.transform("_m", lambda m, i: F.struct(start(i).alias("start"), m.alias("value"), i.alias("i")))
    rows = rows.withColumn("_placed", F.filter(placed, lambda m: confirmed(kind.name, m["value"])))
    # a piece and the match after it, a match and the piece after it; a cut one fills the context
    ends = F.transform("_m", lambda m, i: F.right(F.concat(F.get("_b", i), m), F.lit(CONTEXT)))
    begins = F.transform("_m", lambda m, i: F.left(F.concat(m, F.get("_b", i + 1)), F.lit(CONTEXT)))
    some = F.size("_placed") > 0
    rows = rows.withColumns(
        {"_ends": F.when(some, ends).otherwise(nothing), "_begins": F.when(some, begins).otherwise(nothing)}
    )
    near = -(-CONTEXT // kind.least)
    around = lambda i: F.concat(
        F.right(
            F.concat(
                F.array_join(F.slice("_ends", F.greatest(i - near, F.lit(0)) + 1, F.least(i, F.lit(near))), ""),
                F.right(F.get("_b", i), F.lit(CONTEXT)),
            ),
            F.lit(CONTEXT),
        ),
        F.lit("\n"),
        F.left(
            F.concat(
                F.left(F.get("_b", i + 1), F.lit(CONTEXT)),
                F.array_join(F.slice("_begins", i + 2, F.lit(near)), ""),
            ),
            F.lit(CONTEXT),
        ),
    )
    found = F.transform(
        "_placed", lambda m: F.struct(m["start"], m["value"], around(m["i"]).alias("around"))
    )
    return rows.withColumn(f"_{kind.name}", found).drop(
        "_m", "_b", "_before", "_steps", "_blocks", "_placed", "_ends", "_begins"
    )


def _scored(kind: Kind) -> Column:
    """The matches of a kind as (kind, start, end, value, score) in the order of the text."""
    near = rf"(?i)\b(?:{'|'.join(kind.words)})"

    def span(m: Column) -> Column:
        end = m["start"] + F.length(m["value"])
        gain = F.when(m["around"].rlike(near), F.lit(CONTEXT_GAIN)).otherwise(0.0)
        return F.struct(
            F.lit(kind.name).alias("kind"),
            m["start"].alias("start"),
            end.alias("end"),
            m["value"].alias("value"),
            F.least(F.lit(1.0), kind.score + gain).alias("score"),
        )

    return F.transform(f"_{kind.name}", span)


def with_spans(docs: DataFrame, text_column: str = "text", into: str = "spans") -> DataFrame:
    """``docs`` with an array of (kind, start, end, value, score), by kind and then by start.

    Places count code points from 0, the end is exclusive. NULL and empty texts have no spans.
    Repeated rows are handled each; the columns of ``docs`` stay as they are, whatever their
    names, but a column named like ``into`` is replaced.
    """
    carried = docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("_row"),
        F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("_text"),
    )
    for kind in KINDS:
        carried = _with_matches(carried, kind)
    for kind in KINDS:
        carried = carried.withColumn(f"_{kind.name}", _scored(kind))
    every = F.concat(*(F.col(f"_{kind.name}") for kind in KINDS))
    names = [c for c in docs.columns if c != into]
    return carried.select(
        *(F.col("_row")[c].alias(c) for c in names),
        F.filter(every, lambda s: s["score"] >= THRESHOLD).alias(into),
    )


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first
    names the place and all their characters go."""
    ordered = F.sort_array(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    joined = F.aggregate(
        ordered,
        begin,
        lambda done, s: F.struct(
            F.greatest(done["at"], s["end"]).alias("at"),
            F.when(
                s["start"] >= done["at"],
                F.concat(
                    done["parts"],
                    F.array(
                        F.substring(text, done["at"] + 1, s["start"] - done["at"]),
                        F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")),
                    ),
                ),
            )
            .otherwise(done["parts"])
            .alias("parts"),
        ),
        lambda done: F.concat(
            F.array_join(done["parts"], ""), F.substring(text, done["at"] + 1, F.length(text))
        ),
    )
    return F.when(F.size(spans) > 0, joined).otherwise(text)


def op6_pii_spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_spans(docs)
    names = [kind.name for kind in BASE]
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    base = as_text(F.filter("spans", lambda s: s["kind"].isin(names)))
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in names),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
    )


def pii_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data masked and ``n_chars`` counted anew."""
    found = with_spans(docs, into="_spans")
    text = masked(F.col("text"), F.col("_spans"))
    return (
        found.withColumn("text", text)
        .withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
        .select(*docs.columns)
    )
