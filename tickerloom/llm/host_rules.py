"""Quality rules with host verdicts.

Every document is measured, and soft rules flag what looks wrong with it. Failures are added up
by host; for each rule a beta prior is fitted to the hosts' failure rates by their first two
moments, less the spread that counting alone gives, and each host's rate is shrunk to it, so
that a host with few documents is judged by what is usual and one with many by its own record.

The rates are joined back. A document that fails a rule at ``x`` times its limit is held against
its host's shrunk rate ``s`` by their posterior: the odds ``s / (1 - s)`` of what such a host brings,
times ``x ** 8`` for its own excess. At even odds it goes. So a host that fails a rule half of the
time brings down whatever fails it, a usual host only what is well beyond the limit, and there is a
deciding excess for every rate. A document also goes if it fails two soft rules, or has twice the
symbols or capitals allowed. A document that fails none stays, wherever it comes from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import stored, table, words

MIN_WORDS = 50
#: A host of this shrunk rate is bad in a rule: any failure of it suffices.
BAD_RATE = 0.5
#: Bounds of a prior's weight in documents; the upper one also serves hosts without spread.
PRIOR_WEIGHT = (2.0, 1000.0)
SYMBOLS = "#*$%&|<>"
RULES = ["symbols", "capitals", "dup_lines", "repeats", "word_length"]
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def measured(docs: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """``keep`` and the measures of every text, all inside the row and without a shuffle.

    Three-word windows are compared by 64-bit hashes within one text. Equal windows are found
    by sorting, so a text of any length takes n log n steps.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.select(*keep, text.alias("_t"), words(text).alias("_w"), lines.alias("_l"))
    step = step.select(
        *keep,
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.length("_t") - F.length(F.translate("_t", CAPITALS, ""))).cast("bigint").alias("n_capitals"),
        F.size("_l").cast("bigint").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    window = F.transform(
        F.sequence(F.lit(0), F.size("_h") - 3),
        lambda i: F.xxhash64(F.get("_h", i), F.get("_h", i + 1), F.get("_h", i + 2)),
    )
    none = F.array().cast("array<bigint>")
    step = step.withColumn("_x", F.when(F.size("_h") >= 3, window).otherwise(none)).drop("_h")
    placed = F.sort_array(F.transform("_x", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    repeats = F.size(F.array_distinct("_x")) < F.size("_x")
    step = step.withColumn(
        "_s", F.when(repeats, placed).otherwise(F.array().cast("array<struct<x:bigint,i:int>>"))
    ).drop("_x")
    again = F.filter(
        "_s",
        lambda s, j: ((j > 0) & (F.get("_s", j - 1)["x"] == s["x"]))
        | F.coalesce(F.get("_s", j + 1)["x"] == s["x"], F.lit(False)),
    )
    step = step.withColumn("_p", F.sort_array(F.transform(again, lambda s: s["i"]))).drop("_s")
    covered = F.aggregate(
        F.transform("_p", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_p", j + 1) - p, F.lit(3)))),
        F.lit(0).cast("bigint"),
        lambda total, n: total + n,
    )
    return step.withColumn("n_repeat_words", covered).drop("_p")


def _excess() -> dict[str, Column]:
    """How many times its limit a text has, by rule; over 1 it fails. NULL where nothing is measured."""
    w, c, n = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    return {
        "symbols": F.try_divide(100 * F.col("n_symbols"), 6 * c),
        "capitals": F.try_divide(10 * F.col("n_capitals"), 3 * c),
        "dup_lines": F.try_divide(10 * F.col("n_dup_lines"), 3 * n),
        "repeats": F.try_divide(4 * F.col("n_repeat_words"), w),
        "word_length": F.greatest(F.try_divide(2 * w, c), F.try_divide(c, 15 * w)),
    }


def _outweighs(x: Column, rate: Column) -> Column:
    """Whether a failure at ``x`` times the limit is junk at even odds, from a host of that rate."""
    four = (x * x) * (x * x)
    return rate * (four * four) >= 1 - rate


def _gross() -> Column:
    """Twice the limit of symbols or capitals."""
    c = F.col("word_chars")
    return (100 * F.col("n_symbols") > 12 * c) | (10 * F.col("n_capitals") > 6 * c)


def host_verdicts(flagged: DataFrame) -> DataFrame:
    """``(host, rates, bad_rules)`` from ``flagged(host, failures)``, an array of rule names.

    ``rates`` has the shrunk rate of each rule, ``bad_rules`` the names of those that are bad.

    Hosts are aggregated before the shuffle, so a host with a third of all documents costs one
    row per task. The priors have one row for each rule.
    """
    counts = flagged.groupBy("host").agg(
        F.count("*").alias("n"),
        *(F.sum(F.array_contains("failures", r).cast("bigint")).alias(r) for r in RULES),
    )
    by_rule = counts.select(
        "host",
        "n",
        F.explode(
            F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("failed")) for r in RULES))
        ).alias("r"),
    ).select("host", "n", "r.rule", "r.failed")
    rate = F.col("failed") / F.col("n")
    moments = by_rule.groupBy("rule").agg(
        F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("n")).alias("noise")
    )
    low, high = PRIOR_WEIGHT
    even = F.col("m") * (1 - F.col("m"))
    spread = F.col("v") - even * F.col("noise")
    weight = F.when(spread > 0, even / spread - 1).otherwise(high)
    prior = moments.select("rule", "m", F.least(F.greatest(weight, F.lit(low)), F.lit(high)).alias("k"))
    shrunk = (F.col("failed") + F.col("m") * F.col("k")) / (F.col("n") + F.col("k"))
    return (
        by_rule.join(F.broadcast(prior), "rule")  # one row a rule
        .groupBy("host")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("rule", shrunk.alias("rate")))).alias("rates"),
            F.array_sort(F.collect_list(F.when(shrunk >= BAD_RATE, F.col("rule")))).alias("bad_rules"),
        )
    )


def judge(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    host_column: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: id, measures, ``failures``, ``bad_rules``, ``kept``.

    ``bad_rules`` are the failed rules in which the document goes for its host's rate and its excess.

    NULL texts count as empty and fail the base rules, as do all texts under 50 words. A NULL
    host is a host of its own. Repeated rows are judged each. Other columns are not read.
    """
    named = docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(text_column).alias("text"),
        F.col(host_column).cast("string").alias("host"),
    )
    excess = _excess()
    failed = F.array_compact(
        F.array(*(F.when(excess[r] > 1, F.struct(F.lit(r).alias("rule"), excess[r].alias("x"))) for r in RULES))
    )
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    facts = stored(
        measured(named, ["doc_id", "host"]).withColumns(
            {"base_failed": base, "failed": failed, "failures": F.transform(failed, lambda f: f["rule"])}
        ),
        "measures",
    )
    verdicts = host_verdicts(facts.select("host", "failures")).select(F.col("host").alias("_host"), "rates")
    joined = facts.join(verdicts, facts.host.eqNullSafe(F.col("_host")), "left").drop("_host")
    junk = F.filter("failed", lambda f: _outweighs(f["x"], F.try_element_at(F.col("rates"), f["rule"])))
    joined = joined.withColumn("bad_rules", F.transform(junk, lambda f: f["rule"])).drop("failed", "rates")
    worst = (F.size("failures") >= 2) | (F.size("bad_rules") > 0) | _gross()
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(worst, F.lit(False)))


def op3_host_quality_rules(spark, sf_dir):
    """Every document's measures, its failed rules and whether it is kept."""
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "host", "n_lines", "n_capitals",
        F.array_join("failures", ",").alias("failures"),
        F.array_join("bad_rules", ",").alias("bad_rules"),
    )


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose rows are kept, with the columns they came with.

    A row's verdict depends on its text and source alone, so rows are matched by those and the
    id; repeated rows share their verdict.
    """
    key = F.struct(docs.doc_id, F.xxhash64(docs.text).alias("text"), docs.source)
    keyed = docs.select(key.alias("doc_id"), "text", "source")
    kept = judge(keyed).where("kept").select(F.col("doc_id").alias("_key")).distinct()
    return docs.join(kept, key == kept["_key"], "left_semi")


ORACLE_OP3 = r"""
WITH split AS (
  SELECT row_number() OVER () AS row_id, doc_id, source AS host, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                     lambda w: w <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
windows AS (
  SELECT row_id, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) AS said
  FROM (SELECT row_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM split WHERE len(ws) > 2)),
again AS (
  SELECT row_id, i, count(*) OVER (PARTITION BY row_id, said) AS times FROM windows),
covered AS (
  SELECT row_id, count(DISTINCT p) AS n
  FROM (SELECT row_id, unnest([i, i + 1, i + 2]) AS p FROM again WHERE times > 1)
  GROUP BY row_id),
measured AS (
  SELECT s.row_id, doc_id, host, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM split s LEFT JOIN covered c USING (row_id)),
limits AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         [{'rule': 'symbols', 'x': (100 * n_symbols)::DOUBLE / nullif(6 * word_chars, 0)::DOUBLE},
          {'rule': 'capitals', 'x': (10 * n_capitals)::DOUBLE / nullif(3 * word_chars, 0)::DOUBLE},
          {'rule': 'dup_lines', 'x': (10 * n_dup_lines)::DOUBLE / nullif(3 * n_lines, 0)::DOUBLE},
          {'rule': 'repeats', 'x': (4 * n_repeat_words)::DOUBLE / nullif(n_words, 0)::DOUBLE},
          {'rule': 'word_length', 'x': greatest((2 * n_words)::DOUBLE / nullif(word_chars, 0)::DOUBLE,
             word_chars::DOUBLE / nullif(15 * n_words, 0)::DOUBLE)}] AS excess
  FROM measured),
flagged AS (
  SELECT *, list_transform(list_filter(excess, lambda e: e.x > 1), lambda e: e.rule) AS failed FROM limits),
hosts AS (
  SELECT host, count(*)::DOUBLE AS n, r.rule,
         sum(CASE WHEN list_contains(failed, r.rule) THEN 1 ELSE 0 END)::DOUBLE AS f
  FROM flagged, (SELECT unnest(['symbols', 'capitals', 'dup_lines', 'repeats', 'word_length'])
                   AS rule) r
  GROUP BY host, r.rule),
priors AS (
  SELECT rule, m, CASE WHEN spread > 0
                       THEN least(greatest(m * (1 - m) / spread - 1, 2), 1000) ELSE 1000 END AS k
  FROM (SELECT rule, avg(f / n) AS m,
               var_pop(f / n) - avg(f / n) * (1 - avg(f / n)) * avg(1 / n) AS spread
        FROM hosts GROUP BY rule)),
rates AS (SELECT host, rule, (f + m * k) / (n + k) AS s FROM hosts JOIN priors USING (rule)),
-- the place in the list keeps the order of the rules
failures AS (
  SELECT row_id, host, place, excess[place].rule AS rule, excess[place].x AS x
  FROM (SELECT row_id, host, excess, unnest([1, 2, 3, 4, 5]) AS place FROM flagged)
  WHERE excess[place].x > 1),
verdicts AS (
  SELECT row_id, string_agg(f.rule, ',' ORDER BY place) AS bad
  FROM failures f JOIN rates r ON r.host IS NOT DISTINCT FROM f.host AND r.rule = f.rule
  WHERE s * (((x * x) * (x * x)) * ((x * x) * (x * x))) >= 1 - s
  GROUP BY row_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (len(failed) > 1 OR bad IS NOT NULL
         OR 100 * n_symbols > 12 * word_chars OR 10 * n_capitals > 6 * word_chars) AS kept,
       host, n_lines, n_capitals, array_to_string(failed, ',') AS failures, coalesce(bad, '') AS bad_rules
FROM flagged LEFT JOIN verdicts USING (row_id)
"""
