"""One DuckDB statement per named query, column for column."""

from oracles.views import (
    AS_OF,
    BARS,
    BM,
    CONCEPT,
    COMPANY,
    FACTS,
    FILINGS,
    FORM,
    HOUR_BARS,
    INV,
    LATEST,
    LISTING,
    MCAP,
    MINUTES,
    OLD_STORE,
    OP,
    SEQ,
    SNAPSHOT,
    SNAPSHOT_COLUMNS,
    TICKS,
    TWO_ASSETS,
    INPUTS,
    UNIT,
    UNIVERSE,
    band_rows,
    beta_rows,
    company_at,
    even,
    evaluation,
    known_at,
    rsi_rows,
)

SEQ_BASE = 1 << 32


def r9(expression: str) -> str:
    return even(expression, 9)


def over_ticker(expression: str) -> str:
    return f"{expression} OVER (PARTITION BY ticker ORDER BY ts)"


CHANGES = f"""
chgs AS (
  SELECT ticker, ts, close, close - {over_ticker("lag(close)")} AS chg FROM bars)"""


def resampled(bucket: str, frequency: str) -> str:
    return f"""
WITH {TICKS}
SELECT ticker, time_bucket(INTERVAL '{bucket}', ts) AS ts,
       arg_min(price, ts) AS open, max(price) AS high, min(price) AS low,
       arg_max(price, ts) AS close, count(*) AS n_ticks, '{frequency}' AS freq
FROM ticks GROUP BY ALL"""


RESAMPLED_TIES = """
WITH p AS (
  SELECT o_orderstatus AS ticker, time_bucket(INTERVAL '1 hour', o_orderdate) AS ts,
         o_orderdate AS moment, o_totalprice AS price, o_orderkey AS seq,
         CAST(round_even(o_totalprice * 100::DOUBLE, 0) AS BIGINT) AS volume
  FROM orders),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY ticker, ts ORDER BY moment, seq) AS first_place,
         row_number() OVER (PARTITION BY ticker, ts ORDER BY moment DESC, seq DESC)
           AS last_place
  FROM p)
SELECT ticker, ts, max(CASE WHEN first_place = 1 THEN price END) AS open,
       max(price) AS high, min(price) AS low,
       max(CASE WHEN last_place = 1 THEN price END) AS close, count(*) AS n_ticks,
       CAST(sum(volume) AS BIGINT) AS volume, 'hour' AS freq
FROM placed GROUP BY ticker, ts"""

# DuckDB's upper() maps single characters only, hence the spelled-out special cases.
UPPER_TEXT = """upper(replace(replace(replace(text, 'ß', 'ss'), 'ﬁ', 'fi'), 'ﬂ', 'fl'))"""

TOKENS = f"""
pieces AS (
  SELECT doc_id, unnest(string_split_regex({UPPER_TEXT}, '[\\n,;\\t]+')) AS piece,
         generate_subscripts(string_split_regex({UPPER_TEXT}, '[\\n,;\\t]+'), 1) AS place
  FROM documents),
tokens AS (
  SELECT doc_id AS list,
         row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS ordinal,
         regexp_replace(piece, '[^A-Z.]', '', 'g') AS ticker
  FROM pieces WHERE regexp_replace(piece, '[^A-Z.]', '', 'g') <> '')"""

DOCUMENT_FACTS = f"""
entries AS (
  SELECT o_orderkey AS doc, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik,
         'us-gaap' AS taxonomy, {CONCEPT} AS concept, {UNIT} AS unit, 0::BIGINT AS pos,
         year(o_orderdate) || '-12-31' AS "end",
         strftime(o_orderdate, '%Y-%m-%d') AS filed, {FORM} AS form, o_totalprice AS val
  FROM orders
  UNION ALL
  SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 10, '0'),
         'us-gaap', {CONCEPT}, {UNIT}, 1, (year(o_orderdate) - 1) || '-12-31',
         strftime(o_orderdate, '%Y-%m-%d'), '10-K/A', -o_totalprice
  FROM orders
  UNION ALL
  SELECT o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 10, '0'),
         t.taxonomy, t.concept, t.unit, 0, year(o_orderdate) || '-12-31',
         strftime(o_orderdate, '%Y-%m-%d'), '8-K', o_custkey::DOUBLE
  FROM orders, (VALUES ('us-gaap', 'Liabilities', 'USD'),
                       ('dei', 'EntityPublicFloat', 'pure')) t(taxonomy, concept, unit))"""

MOVING = f"""
averages AS (
  SELECT ticker, ts, close,
         CASE WHEN count(*) OVER w20 >= 20 THEN avg(close) OVER w20 END AS s20,
         CASE WHEN count(*) OVER w50 >= 50 THEN avg(close) OVER w50 END AS s50,
         CASE WHEN count(*) OVER w200 >= 200 THEN avg(close) OVER w200 END AS s200
  FROM bars
  WINDOW w20 AS (PARTITION BY ticker ORDER BY ts ROWS 19 PRECEDING),
         w50 AS (PARTITION BY ticker ORDER BY ts ROWS 49 PRECEDING),
         w200 AS (PARTITION BY ticker ORDER BY ts ROWS 199 PRECEDING)),
sides AS (
  SELECT *, sign(s20 - s50) AS side FROM averages),
turns AS (
  SELECT *, {over_ticker("lag(side)")} AS before FROM sides)"""

ZONE = """CASE WHEN {0} <= 30 THEN 'buy' WHEN {0} >= 70 THEN 'sell'
              WHEN {0} IS NOT NULL THEN 'neutral' END"""


def sorted_by(key: str, direction: str) -> str:
    return f"""
WITH {SNAPSHOT},
keyed AS (SELECT ticker, {key} AS sort_key, {SEQ} AS seq FROM snap)
SELECT ticker, sort_key, seq,
       row_number() OVER (ORDER BY sort_key {direction}, seq) AS pos
FROM keyed"""


def ratio(name: str, expression: str) -> str:
    return f"""
WITH {BARS}, {FILINGS}, {band_rows("band", AS_OF)}
SELECT k.ticker, {expression} AS {name}
FROM cik_map k LEFT JOIN company c USING (cik) LEFT JOIN band_price p USING (ticker)"""


def banded(factor: str, *bands: tuple[str, str]) -> str:
    cases = " ".join(f"WHEN {test} THEN '{label}'" for test, label in bands)
    return (
        f"CASE WHEN {factor} IS NULL THEN NULL {cases} ELSE 'unlabelled' END"
        f" AS {factor}_band"
    )


FACTOR_BANDS = ",\n       ".join(
    [
        banded(
            "bm",
            ("bm < 0.05", "expensive growth"),
            ("bm < 0.2", "growth/blend"),
            ("bm < 0.5", "value tilt"),
            ("bm < 1.0", "deep value"),
            ("bm >= 1.0", "below book"),
        ),
        banded(
            "op",
            ("op < 0", "operating loss"),
            ("op >= 0.05 AND op < 0.15", "mediocre"),
            ("op >= 0.15 AND op < 0.25", "solid"),
            ("op >= 0.25", "high quality"),
        ),
        banded(
            "inv",
            ("inv < 0", "shrinking"),
            ("inv < 0.05", "conservative"),
            ("inv < 0.15", "moderate growth"),
            ("inv >= 0.2", "aggressive expansion"),
        ),
        banded(
            "beta",
            ("beta < 0.6", "defensive"),
            ("beta < 1.0", "below market"),
            ("beta < 1.4", "above market"),
            ("beta >= 1.5", "high volatility"),
        ),
        banded(
            "mcap",
            ("mcap < 2", "small cap"),
            ("mcap < 10", "mid cap"),
            ("mcap < 100", "large cap"),
            ("mcap >= 100", "mega cap"),
        ),
    ]
)

TARGETS = {
    "beta": "coalesce(beta BETWEEN 0.6 AND 1.0, false)",
    "mcap": "coalesce(mcap BETWEEN 2 AND 10, false)",
    "bm": "coalesce(bm > 0.20, false)",
    "op": "coalesce(op > 0.15, false)",
    "inv": "coalesce(inv < 0.10, false)",
}

PLAIN_PERCENT = (
    "regexp_replace(printf('%.2f', pct_below_ci), '\\.?0+$', '') || '%'"
)


def shown(factor: str, form: str) -> str:
    return f"CASE WHEN {factor} IS NULL THEN '—' ELSE printf('{form}', {factor}) END"


def settled(seeds: str) -> str:
    """The rows a refresh leaves of the CTE ``seeds``, given the CTE ``fresh``."""
    columns = ", ".join(
        f"CASE WHEN renewed THEN f.{name} ELSE s.{name} END AS {name}"
        for name in ("pct_below_ci", "rsi", "bm", "op", "inv", "beta", "mcap")
    )
    return f"""
SELECT s.ticker, {columns}, s.seq,
       CASE WHEN renewed THEN {AS_OF} ELSE s.as_of END AS as_of
FROM {seeds} s
LEFT JOIN (SELECT *, reason IS NULL AS renewed FROM fresh) f USING (ticker)
WHERE renewed
   OR ((f.ticker IS NULL OR reason IN ('no_bars', 'no_price', 'rsi_undefined'))
       AND coalesce(s.rsi, 0) <> 0)"""


def snapshot_at(moment: str) -> str:
    """The snapshot at a moment, from what had been filed by then."""
    return f"""
SELECT * FROM (
  WITH {SNAPSHOT.replace(AS_OF, moment).replace("FROM orders)", f"FROM orders WHERE o_orderdate <= {moment})")}
  SELECT *, {moment} AS as_of FROM snap)"""


HISTORY = ("1997-03-31", "1998-09-01", "2000-06-30", "2001-11-04")

ORACLES = {
    "bars_scan": f"""
WITH {BARS}, {UNIVERSE}
SELECT ticker, ts, close FROM bars
WHERE ts BETWEEN {AS_OF} - INTERVAL 90 DAY AND {AS_OF}
  AND ticker IN (SELECT ticker FROM universe)""",
    "bars_delayed": f"""
WITH {BARS}
SELECT ticker, ts, close FROM bars
WHERE ts BETWEEN {AS_OF} - INTERVAL 10 MINUTE - INTERVAL 5 DAY AND {AS_OF} - INTERVAL 10 MINUTE""",
    "bar_keys": """
SELECT 'S' || l_suppkey AS ticker, l_shipdate AS ts, count(*) AS n
FROM lineitem GROUP BY l_suppkey, l_shipdate HAVING count(*) > 1""",
    "bars_resample_day": resampled("1 day", "day"),
    "bars_resample_hour": resampled("1 hour", "hour"),
    "bars_resample_minute": resampled("1 minute", "minute"),
    "bars_resample_ties": RESAMPLED_TIES,
    "latest_price": f"""
WITH {BARS}, {band_rows("band", AS_OF)}
SELECT ticker, price FROM band_price""",
    "price_widening": f"""
WITH {BARS}, {UNIVERSE}
SELECT ticker, arg_max(close, ts) AS price,
       CASE WHEN max(ts) >= {AS_OF} - INTERVAL 5 MINUTE THEN 5::DOUBLE / 1440::DOUBLE
            WHEN max(ts) >= {AS_OF} - INTERVAL 1 DAY THEN 1::DOUBLE
            WHEN max(ts) >= {AS_OF} - INTERVAL 3 DAY THEN 3::DOUBLE ELSE 5::DOUBLE END AS "window"
FROM bars WHERE ts BETWEEN {AS_OF} - INTERVAL 5 DAY AND {AS_OF}
  AND ticker IN (SELECT ticker FROM universe) GROUP BY ticker""",
    "bars_merge": f"""
WITH {BARS},
numbered AS (SELECT *, TRY_CAST(substr(ticker, 2) AS BIGINT) AS number FROM bars),
settled AS (
  SELECT ticker, ts,
         CASE WHEN ts >= TIMESTAMP '2001-10-01' AND number % 4 = 0 THEN NULL
              WHEN ts >= TIMESTAMP '2001-06-01' AND number % 3 = 0 THEN close + 2::DOUBLE
              ELSE close END AS close
  FROM numbered)
SELECT ticker, 'day' AS freq, ts, close FROM settled WHERE close IS NOT NULL""",
    "list_lines": f"WITH {TOKENS} SELECT list, ordinal, ticker FROM tokens",
    "parse_tickers": f"WITH {TOKENS} SELECT list, ordinal, ticker FROM tokens",
    "list_overview": f"""
WITH {TOKENS}
SELECT d.doc_id AS list, count(ticker) AS n_tickers,
       coalesce(string_agg(ticker, ', ' ORDER BY ordinal) FILTER (ordinal < 12), '')
         AS first_tickers,
       greatest(count(ticker) - 12, 0) AS n_more
FROM documents d LEFT JOIN tokens t ON t.list = d.doc_id GROUP BY d.doc_id""",
    "list_names": "SELECT DISTINCT source AS list FROM documents",
    "cik_dim": """
WITH entries AS (
  SELECT s_suppkey AS doc, 0 AS pos, 'S' || s_suppkey AS ticker, s_suppkey AS number
  FROM supplier
  UNION ALL
  SELECT s_suppkey, 1, 'N' || s_nationkey, s_suppkey * 7 FROM supplier)
SELECT ticker, lpad(CAST(number AS VARCHAR), 10, '0') AS cik FROM entries
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY doc DESC, pos DESC) = 1""",
    "facts_flatten": f"WITH {DOCUMENT_FACTS} SELECT * FROM entries",
    "facts_named": f"""
WITH {DOCUMENT_FACTS}
SELECT * EXCLUDE (cik) FROM entries
WHERE taxonomy = 'us-gaap' AND concept <> 'Liabilities'""",
    "names_normalized": """
SELECT s_suppkey, upper(trim(s_name)) AS ticker,
       regexp_replace(lower(trim(s_name)), '[^a-z0-9_]', '_', 'g') AS universe,
       s_acctbal < 5000 AS is_portfolio,
       lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik
FROM supplier""",
    "close_diff": f"""
WITH {BARS}, {CHANGES}
SELECT ticker, ts, {r9("chg")} AS chg FROM chgs WHERE chg IS NOT NULL""",
    "simple_returns": f"""
WITH {BARS},
r AS (SELECT ticker, ts, close / nullif({over_ticker("lag(close)")}, 0) - 1 AS ret
      FROM bars)
SELECT ticker, ts, {r9("ret")} AS ret FROM r WHERE ret IS NOT NULL""",
    "gain_loss": f"""
WITH {BARS}, {CHANGES}
SELECT ticker, ts, {r9("greatest(chg, 0)")} AS gain, {r9("least(chg, 0)")} AS loss
FROM chgs WHERE chg IS NOT NULL""",
    "sma_14": f"""
WITH {BARS}
SELECT ticker, ts,
       CASE WHEN count(*) OVER w >= 14 THEN {r9("avg(close) OVER w")} END AS sma_14
FROM bars
WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS 13 PRECEDING)""",
    "sma_intraday": f"""
WITH {TICKS}
SELECT ticker, ts,
       CASE WHEN count(*) OVER w >= 20 THEN {r9("avg(price) OVER w")} END AS sma_20
FROM ticks
WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS 19 PRECEDING)""",
    "rsi_series": f"""
WITH {BARS}, {rsi_rows("r", "bars")}
SELECT ticker, ts, {r9("rsi")} AS rsi FROM r""",
    "rsi_series_intraday": f"""
WITH {TICKS}, t AS (SELECT ticker, ts, price AS close FROM ticks), {rsi_rows("r", "t")}
SELECT ticker, ts, {r9("rsi")} AS rsi FROM r""",
    "rsi_latest": f"""
WITH {BARS},
{rsi_rows("r", "bars", f"ts BETWEEN {AS_OF} - INTERVAL 720 DAY AND {AS_OF}")}
SELECT ticker, CAST(round_even(rsi, 0) AS INTEGER) AS rsi FROM r
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) = 1""",
    "rsi_at_date": f"""
WITH {BARS},
{rsi_rows("r", "bars", f"ts BETWEEN {AS_OF} - INTERVAL 720 DAY AND {AS_OF}")}
SELECT ticker, ts, CAST(round_even(rsi, 0) AS INTEGER) AS rsi FROM r
WHERE ts = TIMESTAMP '2001-10-15'""",
    "rsi_at_requests": f"""
WITH {BARS}, {rsi_rows("r", "bars")},
asked AS (SELECT DISTINCT 'S' || (o_custkey % 10 + 1) AS ticker, o_orderdate AS ts FROM orders)
SELECT a.ticker, a.ts,
       CASE WHEN r.ts = a.ts THEN CAST(round_even(r.rsi, 0) AS INTEGER) END AS rsi_exact,
       r.ts AS bar_ts, CAST(round_even(r.rsi, 0) AS INTEGER) AS rsi_as_of
FROM asked a ASOF LEFT JOIN r ON a.ticker = r.ticker AND a.ts >= r.ts""",
    "ma_cross": f"""
WITH {BARS}, {MOVING}
SELECT ticker, ts, {r9("s20")} AS sma_20, {r9("s50")} AS sma_50, {r9("s200")} AS sma_200,
       CAST(close > s20 AS VARCHAR) AS above_20, CAST(close > s50 AS VARCHAR) AS above_50,
       CAST(close > s200 AS VARCHAR) AS above_200,
       CASE WHEN before <= 0 AND side > 0 THEN 'up'
            WHEN before >= 0 AND side < 0 THEN 'down' END AS "cross"
FROM turns""",
    "rsi_accuracy": f"""
WITH {BARS}, {rsi_rows("r", "bars")},
signals AS (
  SELECT ticker, {ZONE.format("rsi")} AS zone,
         lead(close, 5) OVER (PARTITION BY ticker ORDER BY ts) - close AS moved
  FROM r),
judged AS (
  SELECT ticker, CASE WHEN moved IS NULL THEN NULL
                      WHEN zone = 'buy' THEN (moved > 0)::INT
                      WHEN zone = 'sell' THEN (moved < 0)::INT END AS hit
  FROM signals)
SELECT ticker, count(hit) AS n_signals,
       {r9("CAST(sum(hit) AS DOUBLE) / nullif(count(hit), 0)")} AS accuracy
FROM judged GROUP BY ticker""",
    "rsi_turnover": f"""
WITH {BARS}, {rsi_rows("r", "bars")},
zones AS (SELECT ticker, ts, {ZONE.format("rsi")} AS zone FROM r),
turns AS (SELECT *, {over_ticker("lag(zone)")} AS before FROM zones)
SELECT ticker, CAST(year(ts) AS INTEGER) AS year,
       count(*) FILTER (zone <> before) AS n_changes
FROM turns GROUP BY ALL""",
    "ci_distance": f"""
WITH {BARS}, {band_rows("band", AS_OF)}
SELECT ticker, band_bars, {r9("mean_close")} AS mean_close,
       {r9("std_close")} AS std_close, {r9("lower_band")} AS lower_band, price,
       pct_below_ci
FROM band""",
    "penny_filter": f"""
WITH {BARS}, {band_rows("band", AS_OF)}
SELECT ticker, last_close FROM band WHERE last_close > 5""",
    "beta": f"WITH {BARS}, {beta_rows('b', AS_OF)} SELECT ticker, beta FROM b",
    "beta_intraday": f"""
WITH {HOUR_BARS}, {beta_rows("b", "TIMESTAMP '2024-02-01'")}
SELECT ticker, n_common, beta FROM b""",
    "return_overlap": f"""
WITH {BARS}, {beta_rows("b", AS_OF)} SELECT ticker, n_common FROM b""",
    "facts_dedup": f"""
WITH {FACTS}
SELECT cik, taxonomy, concept, unit, "end", pos, filed, form, val FROM periods""",
    "latest_annual": f"""
WITH {FACTS}, {LATEST}
SELECT cik, taxonomy, concept, unit, "end", val FROM latest""",
    "unit_preference": f"""
WITH {FACTS}
SELECT cik, taxonomy, concept, arg_min(unit, unit_rank) AS unit FROM annual
GROUP BY cik, taxonomy, concept""",
    "two_annual": f"WITH {FACTS}, {TWO_ASSETS} SELECT cik, curr, prev FROM two_assets",
    "concept_fallback": f"""
WITH {FACTS}, {LATEST}, {TWO_ASSETS}, {COMPANY}
SELECT cik, equity, shares, op_income, assets, prior_assets FROM company""",
    "ratio_bm": ratio("bm", BM),
    "ratio_mcap": ratio("mcap", MCAP),
    "ratio_op": ratio("op", OP),
    "ratio_inv": ratio("inv", INV),
    "factor_record": f"""
WITH {BARS}, {FILINGS}, {band_rows("band", AS_OF)}, {beta_rows("b", AS_OF)}
SELECT b.ticker, {BM} AS bm, {OP} AS op, {INV} AS inv, b.beta, {MCAP} AS mcap
FROM b LEFT JOIN band_price p USING (ticker) LEFT JOIN cik_map k USING (ticker)
LEFT JOIN company c USING (cik)""",
    "snapshot": f"WITH {SNAPSHOT} SELECT * FROM snap",
    "snapshot_minute_price": f"""
WITH {INPUTS}, {MINUTES}, {evaluation("evaluated", AS_OF, "universe", "minutes")}
SELECT {SNAPSHOT_COLUMNS} FROM evaluated WHERE reason IS NULL""",
    "store_round_trip": f"""
WITH {OLD_STORE}
SELECT *, 2::BIGINT AS version FROM stored
WHERE ticker NOT IN (SELECT ticker FROM listing)""",
    "store_reset": f"""
WITH {OLD_STORE}
SELECT 'before' AS stage, count(*) AS n FROM stored
UNION ALL SELECT 'after', 0 UNION ALL SELECT 'p_reset', 2""",
    "facts_unparsed": """
SELECT * FROM (
  SELECT o_orderkey AS doc,
         CASE o_orderkey % 10 WHEN 3 THEN 'malformed' WHEN 4 THEN 'empty'
                              WHEN 5 THEN 'no_facts' WHEN 6 THEN 'no_cik' END AS reason
  FROM orders)
WHERE reason IS NOT NULL""",
    "bars_resample_nan": f"""
WITH {TICKS}
SELECT ticker, time_bucket(INTERVAL '1 day', ts) AS ts,
       arg_min(price, ts) AS open, max(price) AS high, min(price) AS low,
       arg_max(price, ts) AS close, count(*) AS n_ticks, 'day' AS freq
FROM ticks WHERE seq % 7 <> 0 GROUP BY ALL""",
    "snapshot_as_of": "UNION ALL".join(snapshot_at(f"TIMESTAMP '{day}'") for day in HISTORY),
    "filing_intervals": f"""
WITH {FACTS},
days AS (
  SELECT * FROM annual
  QUALIFY row_number() OVER (PARTITION BY cik, taxonomy, concept, unit, "end", filed ORDER BY pos) = 1)
SELECT cik, taxonomy, concept, unit, "end", pos, filed, form, val, filed AS known_from,
       lead(filed) OVER (PARTITION BY cik, taxonomy, concept, unit, "end" ORDER BY filed) AS known_to
FROM days""",
    "facts_as_of": f"""
WITH {FACTS},
days AS (SELECT DISTINCT strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS as_of FROM orders),
{known_at("known", "days")}
SELECT as_of, cik, taxonomy, concept, unit, "end", pos, filed, form, val FROM known""",
    "company_values_as_of": f"""
WITH {FACTS},
days AS (
  SELECT DISTINCT lpad(CAST(o_custkey % 100 AS VARCHAR), 10, '0') AS cik,
         strftime(make_date(year(o_orderdate), o_custkey % 100 % 12 + 1, 15), '%Y-%m-%d') AS as_of
  FROM orders),
{known_at("known", "days", "f.cik = d.cik")}, {company_at("values_then", "known")}
SELECT as_of, cik, equity, shares, op_income, assets, prior_assets FROM values_then""",
    "snapshot_rejects": f"""
WITH {SNAPSHOT} SELECT ticker, reason FROM evaluated WHERE reason IS NOT NULL""",
    "run_counts": f"""
WITH {SNAPSHOT}
SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS n_tickers
FROM evaluated GROUP BY ALL""",
    "ticker_lookup": f"""
WITH {INPUTS}, {LISTING}, {evaluation("answers", AS_OF, "listing")},
judged AS (
  SELECT *, CASE WHEN rsi IS NULL THEN 'error'
                 WHEN reason IS NULL OR reason = 'rsi_zero' THEN 'ok'
                 ELSE 'not_found' END AS status
  FROM answers)
SELECT ticker, status,
       {", ".join(f"CASE WHEN status = 'ok' THEN {c}::DOUBLE END AS {c}"
                  for c in SNAPSHOT_COLUMNS.split(", ")[1:])}
FROM judged""",
    "coverage_report": f"""
WITH {BARS}, {UNIVERSE}
SELECT u.ticker, max(ts) AS last_ts, count(ts) > 0 AS covered
FROM universe u LEFT JOIN bars b
  ON b.ticker = u.ticker AND ts BETWEEN {AS_OF} - INTERVAL 5 DAY AND {AS_OF}
GROUP BY u.ticker""",
    "coverage_counts": f"""
WITH {BARS}, {UNIVERSE},
c AS (SELECT u.ticker IN (SELECT ticker FROM bars
                          WHERE ts BETWEEN {AS_OF} - INTERVAL 5 DAY AND {AS_OF}) AS covered
      FROM universe u)
SELECT covered, count(*) AS n_tickers FROM c GROUP BY covered""",
    "sort_ci": sorted_by("coalesce(pct_below_ci, 0)", "DESC"),
    "sort_rsi": sorted_by("coalesce(rsi, 0)::DOUBLE", "DESC"),
    "sort_bm": sorted_by("coalesce(nullif(bm, 0), -999)", "DESC"),
    "sort_op": sorted_by("coalesce(nullif(op, 0), -999)", "DESC"),
    "sort_inv": sorted_by("coalesce(inv, 999)", "ASC"),
    "sort_beta": sorted_by("coalesce(beta, 999)", "ASC"),
    "sort_mcap": sorted_by("coalesce(mcap, 999)", "ASC"),
    "topk_ci": f"""
WITH {SNAPSHOT}
SELECT *, {SEQ} AS seq FROM snap
ORDER BY coalesce(pct_below_ci, 0) DESC, seq LIMIT 25""",
    "screen_targets": f"""
WITH {SNAPSHOT}
SELECT * FROM snap WHERE {" AND ".join(TARGETS.values())}""",
    "screen_value": f"""
WITH {SNAPSHOT}
SELECT * FROM snap
WHERE {TARGETS["mcap"]} AND {TARGETS["bm"]} AND {TARGETS["op"]}""",
    "target_score": f"""
WITH {SNAPSHOT}
SELECT ticker, {", ".join(f"{test} AS {name}_ok" for name, test in TARGETS.items())},
       {" + ".join(f"({test})::INT" for test in TARGETS.values())} AS n_passed
FROM snap""",
    "factor_bands": f"WITH {SNAPSHOT} SELECT ticker, {FACTOR_BANDS} FROM snap",
    "report_view": f"""
WITH {SNAPSHOT}
SELECT ticker,
       CASE WHEN pct_below_ci IS NULL THEN '—' ELSE {PLAIN_PERCENT} END AS pct_below_ci,
       coalesce(CAST(rsi AS VARCHAR), '—') AS rsi,
       {shown("beta", "%.2f")} AS beta, {shown("mcap", "%.2f")} AS mcap,
       {shown("bm", "%.3f")} AS bm,
       CASE WHEN op IS NULL THEN '—' ELSE printf('%.1f%%', op * 100) END AS op,
       CASE WHEN inv IS NULL THEN '—' ELSE printf('%.1f%%', inv * 100) END AS inv
FROM snap""",
    "export_json": f"""
WITH {SNAPSHOT}
SELECT ticker, CAST(json_object('Ticker', ticker, '% Below 95% CI', pct_below_ci,
       'RSI', rsi, 'BM', bm, 'OP', op, 'INV', inv, 'BETA', beta, 'MCAP', mcap) AS VARCHAR)
       AS json
FROM snap""",
    "search_list": f"""
WITH {TICKS}
SELECT ticker, seq, ts, price FROM ticks
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY seq DESC) = 1""",
    "search_remove": f"""
WITH {TICKS}
SELECT ticker, seq, ts, price FROM ticks WHERE ticker <> 'U1'
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY seq DESC) = 1""",
    "universe_create": f"""
WITH {OLD_STORE},
wanted AS (SELECT ticker FROM stored UNION SELECT ticker FROM listing),
{evaluation("fresh", AS_OF, "wanted")},
listed AS (SELECT ticker, min(ordinal) AS ordinal FROM listing GROUP BY ticker),
seeds AS (
  SELECT coalesce(o.ticker, l.ticker) AS ticker,
         {", ".join(f"CASE WHEN l.ticker IS NULL THEN o.{c} END AS {c}"
                    for c in SNAPSHOT_COLUMNS.split(", ")[1:])},
         coalesce(seq, ordinal + {SEQ_BASE}) AS seq,
         CASE WHEN l.ticker IS NULL THEN as_of END AS as_of
  FROM stored o FULL JOIN listed l ON o.ticker = l.ticker)
{settled("seeds")}""",
    "universe_refresh": f"""
WITH {OLD_STORE}, {evaluation("fresh", AS_OF, "stored")}
{settled("stored")}""",
    "universe_add": f"""
WITH {OLD_STORE}, {evaluation("fresh", AS_OF, "listing")},
listed AS (SELECT ticker, min(ordinal) AS ordinal FROM listing GROUP BY ticker)
SELECT * FROM stored
UNION ALL
SELECT {SNAPSHOT_COLUMNS}, ordinal + {SEQ_BASE}, {AS_OF}
FROM fresh JOIN listed USING (ticker)
WHERE (reason IS NULL OR reason = 'rsi_zero')
  AND ticker NOT IN (SELECT ticker FROM stored)""",
    "universe_remove": f"""
WITH {OLD_STORE}
SELECT * FROM stored WHERE ticker NOT IN (SELECT ticker FROM listing)""",
}
ORACLES["refresh_incremental"] = ORACLES["universe_refresh"]
# The same rows by another way.
ORACLES["facts_variant"] = ORACLES["facts_flatten"]
ORACLES["faults_variant"] = ORACLES["facts_unparsed"]
ORACLES["run_counts_written"] = ORACLES["run_counts"]
ORACLES["snapshot_bucketed"] = ORACLES["snapshot"]

ORDERS = {
    "normal": "coalesce(pct_below_ci, 0) DESC",
    "rsi": "coalesce(rsi, 0) DESC",
    "bm": "coalesce(nullif(bm, 0), -999) DESC",
    "op": "coalesce(nullif(op, 0), -999) DESC",
    "inv": "coalesce(inv, 999) ASC",
    "beta": "coalesce(beta, 999) ASC",
    "mcap": "coalesce(mcap, 999) ASC",
}
PAGES = " UNION ALL ".join(
    f"(SELECT '{choice}' AS choice, ticker, seq FROM numbered ORDER BY {order}, seq LIMIT 3 OFFSET 6)"
    for choice, order in ORDERS.items()
)
ORACLES["pages_by_key"] = f"""
WITH {SNAPSHOT},
numbered AS (SELECT *, {SEQ} AS seq FROM snap)
SELECT * FROM ({PAGES})"""
