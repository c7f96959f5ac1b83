"""Common table expressions for the derived inputs (FIXTURES.md), in DuckDB SQL."""



def even(expression: str, digits: int) -> str:
    """Half-even rounding without a negative zero."""
    return f"(round_even({expression}, {digits}) + 0::DOUBLE)"


AS_OF = "TIMESTAMP '2001-11-04'"
OLD_AS_OF = "TIMESTAMP '2001-08-01'"

B0 = """
lines AS (
  SELECT l_suppkey, l_shipdate AS ts,
         CAST(sum(CAST(round_even(l_extendedprice * 100::DOUBLE, 0) AS BIGINT)) AS BIGINT)
           AS cents,
         count(*) AS n
  FROM lineitem GROUP BY l_suppkey, l_shipdate),
b0 AS (
  SELECT 'S' || l_suppkey AS ticker, ts,
         CAST(round_even((100::DOUBLE + (cents::DOUBLE / n::DOUBLE) / 100000::DOUBLE)
           * (CASE WHEN l_suppkey % 10 = 7 THEN 0.03::DOUBLE ELSE 1::DOUBLE END)
           * 10000::DOUBLE, 0) AS BIGINT) AS ticks
  FROM lines)"""

BARS = (
    B0
    + """,
bars AS (
  SELECT ticker, ts, ticks::DOUBLE / 10000::DOUBLE AS close FROM b0
  UNION ALL
  SELECT 'MKT', ts,
         CAST(round_even(CAST(sum(ticks) AS BIGINT)::DOUBLE / count(*)::DOUBLE, 0)
           AS BIGINT)::DOUBLE / 10000::DOUBLE
  FROM b0 GROUP BY ts)"""
)

UNIVERSE = """
universe AS (
  SELECT 'S' || s_suppkey AS ticker FROM supplier UNION ALL SELECT 'MKT')"""

TICKS = """
ticks AS (
  SELECT 'U' || user_id AS ticker, ts, value AS price, event_id AS seq FROM events)"""

CONCEPT = """CASE o_orderpriority
    WHEN '1-URGENT' THEN 'StockholdersEquity'
    WHEN '2-HIGH' THEN 'CommonStockSharesOutstanding'
    WHEN '3-MEDIUM' THEN 'OperatingIncomeLoss'
    WHEN '4-NOT SPECIFIED' THEN 'Assets'
    ELSE 'StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest' END"""

UNIT = """CASE WHEN o_orderpriority <> '2-HIGH'
    OR (o_orderkey % 17 = 0 AND o_custkey % 2 = 0) THEN 'USD' ELSE 'shares' END"""

FORM = """CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-K/A' ELSE '10-Q' END"""

FACTS = f"""
facts AS (
  SELECT lpad(CAST(o_custkey % 100 AS VARCHAR), 10, '0') AS cik,
         'us-gaap' AS taxonomy,
         {CONCEPT} AS concept,
         {UNIT} AS unit,
         o_orderkey AS pos,
         year(o_orderdate) || '-12-31' AS "end",
         strftime(o_orderdate, '%Y-%m-%d') AS filed,
         {FORM} AS form,
         CASE WHEN o_orderkey % 11 = 0 THEN 0::DOUBLE
              WHEN o_orderkey % 13 = 0 THEN -amount
              ELSE amount END AS val
  FROM (SELECT *, o_totalprice * (CASE o_orderpriority
          WHEN '2-HIGH' THEN 100::DOUBLE ELSE 10000::DOUBLE END) AS amount
        FROM orders)),
annual AS (
  SELECT *, CASE unit WHEN 'USD' THEN 0 WHEN 'shares' THEN 1 WHEN 'pure' THEN 2 END
           AS unit_rank
  FROM facts
  WHERE form IN ('10-K', '10-K/A') AND unit IN ('USD', 'shares', 'pure')),
periods AS (
  SELECT * FROM annual
  QUALIFY row_number() OVER (PARTITION BY cik, taxonomy, concept, unit, "end"
                             ORDER BY filed DESC, pos) = 1)"""

LATEST = """
latest AS (
  SELECT cik, taxonomy, concept, unit, "end", val
  FROM (SELECT *, min(unit_rank) OVER (PARTITION BY cik, taxonomy, concept) AS best
        FROM periods)
  WHERE unit_rank = best
  QUALIFY row_number() OVER (PARTITION BY cik, taxonomy, concept ORDER BY "end" DESC) = 1)"""

TWO_ASSETS = """
asset_periods AS (
  SELECT cik, val, row_number() OVER (PARTITION BY cik ORDER BY "end" DESC) AS place,
         count(*) OVER (PARTITION BY cik) AS n
  FROM periods WHERE concept = 'Assets' AND unit = 'USD'),
two_assets AS (
  SELECT cik,
         max(CASE WHEN place = 1 AND n > 1 THEN val END) AS curr,
         max(CASE WHEN place = 2 THEN val END) AS prev
  FROM asset_periods GROUP BY cik)"""

COMPANY = """
wide AS (
  SELECT cik,
    max(CASE WHEN concept = 'StockholdersEquity' THEN val END) AS equity1,
    max(CASE WHEN concept =
      'StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest'
      THEN val END) AS equity2,
    max(CASE WHEN concept = 'CommonStockSharesOutstanding' THEN val END) AS shares1,
    max(CASE WHEN concept = 'OperatingIncomeLoss' THEN val END) AS income1
  FROM latest GROUP BY cik),
company AS (
  SELECT w.cik,
         coalesce(nullif(equity1, 0), equity2) AS equity,
         nullif(shares1, 0) AS shares,
         nullif(income1, 0) AS op_income,
         a.curr AS assets, a.prev AS prior_assets
  FROM wide w LEFT JOIN two_assets a USING (cik))"""



def company_at(name: str, known: str) -> str:
    """CTE with company values per day ``as_of`` from the CTE ``known`` of facts known then."""
    return f"""
{name}_latest AS (
  SELECT as_of, cik, concept, "end", val
  FROM (SELECT *, min(unit_rank) OVER (PARTITION BY as_of, cik, concept) AS best FROM {known})
  WHERE unit_rank = best
  QUALIFY row_number() OVER (PARTITION BY as_of, cik, concept ORDER BY "end" DESC) = 1),
{name}_assets AS (
  SELECT as_of, cik, val, row_number() OVER (PARTITION BY as_of, cik ORDER BY "end" DESC) AS place,
         count(*) OVER (PARTITION BY as_of, cik) AS n
  FROM {known} WHERE concept = 'Assets' AND unit = 'USD'),
{name}_growth AS (
  SELECT as_of, cik, max(CASE WHEN place = 1 AND n > 1 THEN val END) AS assets,
         max(CASE WHEN place = 2 THEN val END) AS prior_assets
  FROM {name}_assets GROUP BY as_of, cik),
{name}_wide AS (
  SELECT as_of, cik,
    max(CASE WHEN concept = 'StockholdersEquity' THEN val END) AS equity1,
    max(CASE WHEN concept =
      'StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest'
      THEN val END) AS equity2,
    max(CASE WHEN concept = 'CommonStockSharesOutstanding' THEN val END) AS shares1,
    max(CASE WHEN concept = 'OperatingIncomeLoss' THEN val END) AS income1
  FROM {name}_latest GROUP BY as_of, cik),
{name} AS (
  SELECT w.as_of, w.cik, coalesce(nullif(equity1, 0), equity2) AS equity,
         nullif(shares1, 0) AS shares, nullif(income1, 0) AS op_income, assets, prior_assets
  FROM {name}_wide w LEFT JOIN {name}_growth g USING (as_of, cik))"""


def known_at(name: str, days: str, on: str = "true") -> str:
    """CTE with the value of every period known at each ``as_of`` of the CTE ``days``."""
    return f"""
{name} AS (
  SELECT d.as_of, f.* FROM annual f JOIN {days} d ON f.filed <= d.as_of AND {on}
  QUALIFY row_number() OVER (PARTITION BY d.as_of, f.cik, taxonomy, concept, unit, "end"
                             ORDER BY filed DESC, pos) = 1)"""


CIK_MAP = """
cik_map AS (
  SELECT 'S' || s_suppkey AS ticker, lpad(CAST(s_suppkey % 100 AS VARCHAR), 10, '0') AS cik
  FROM supplier WHERE s_acctbal >= 0)"""

BM = f"""CASE WHEN equity <> 0 AND shares > 0 AND price > 0
    THEN {even("equity / (shares * price)", 3)} END"""
MCAP = f"""CASE WHEN shares > 0 AND price > 0
    THEN {even("shares * price / 1e9::DOUBLE", 2)} END"""
OP = f"CASE WHEN equity <> 0 THEN {even('op_income / abs(equity)', 3)} END"
INV = f"""CASE WHEN prior_assets <> 0
    THEN {even("(assets - prior_assets) / abs(prior_assets)", 3)} END"""

FILINGS = ",".join([FACTS, LATEST, TWO_ASSETS, COMPANY, CIK_MAP])

LISTING = """
listing AS (
  SELECT (CASE WHEN s_acctbal >= 4000 THEN 'S' ELSE 'X' END) || s_suppkey AS ticker,
         unnest([s_suppkey * 2 + 1, s_suppkey * 2]) AS ordinal
  FROM supplier)"""


def rsi_rows(name: str, bars: str, where: str = "true") -> str:
    """CTE with the RSI of every bar of ``bars`` that satisfies ``where``."""
    return f"""
{name}_chg AS (
  SELECT ticker, ts, close,
         close - lag(close) OVER (PARTITION BY ticker ORDER BY ts) AS chg
  FROM {bars} WHERE {where}),
{name} AS (
  SELECT ticker, ts, close,
         CASE WHEN n >= 14 AND up + down <> 0 THEN 100 * up / (up + down) END AS rsi
  FROM (SELECT ticker, ts, close,
               sum(greatest(chg, 0)) FILTER (chg IS NOT NULL) OVER w AS up,
               sum(greatest(-chg, 0)) FILTER (chg IS NOT NULL) OVER w AS down,
               count(chg) OVER w AS n
        FROM {name}_chg
        WINDOW w AS (PARTITION BY ticker ORDER BY ts
                     ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)))"""


def beta_rows(name: str, as_of: str) -> str:
    """CTE with the common returns against MKT, 400 days up to ``as_of``."""
    return f"""
{name}_ret AS (
  SELECT ticker, ts, close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY ts), 0)
         - 1 AS ret
  FROM bars WHERE ts BETWEEN {as_of} - INTERVAL 400 DAY AND {as_of}),
{name} AS (
  SELECT r.ticker, count(m.ret) AS n_common,
         CASE WHEN count(m.ret) >= 30 AND var_samp(m.ret) <> 0
              THEN {even("covar_samp(r.ret, m.ret) / var_samp(m.ret)", 2)} END AS beta
  FROM {name}_ret r LEFT JOIN {name}_ret m
    ON m.ticker = 'MKT' AND m.ts = r.ts AND m.ret IS NOT NULL AND r.ret IS NOT NULL
  GROUP BY r.ticker)"""


def band_rows(name: str, as_of: str, prices: str = "bars") -> str:
    """CTE with the price band, 90 days up to ``as_of``, and the price of 5 days."""
    return f"""
{name}_price AS (
  SELECT ticker, arg_max(close, ts) AS price FROM {prices}
  WHERE ts BETWEEN {as_of} - INTERVAL 5 DAY AND {as_of} GROUP BY ticker),
{name} AS (
  SELECT ticker, band_bars, last_close, mean_close, std_close, price,
         mean_close - 2 * std_close AS lower_band,
         {even("(1 - price / nullif(mean_close - 2 * std_close, 0)) * 100", 2)}
           AS pct_below_ci
  FROM (SELECT ticker, count(*) AS band_bars, arg_max(close, ts) AS last_close,
               avg(close) AS mean_close, stddev_samp(close) AS std_close
        FROM bars WHERE ts BETWEEN {as_of} - INTERVAL 90 DAY AND {as_of}
        GROUP BY ticker) LEFT JOIN {name}_price USING (ticker))"""


def evaluation(name: str, as_of: str, universe: str, prices: str = "bars") -> str:
    """CTE with one evaluated row per ticker of the CTE ``universe``."""
    recent = f"ts BETWEEN {as_of} - INTERVAL 720 DAY AND {as_of}"
    return ",".join(
        [
            rsi_rows(f"{name}_rsi", "bars", recent),
            beta_rows(f"{name}_beta", as_of),
            band_rows(f"{name}_band", as_of, prices),
            f"""
{name}_last AS (
  SELECT ticker, CAST(round_even(rsi, 0) AS INTEGER) AS rsi FROM {name}_rsi
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) = 1),
{name} AS (
  SELECT u.ticker, b.pct_below_ci, r.rsi,
         {BM} AS bm, {OP} AS op, {INV} AS inv, t.beta, {MCAP} AS mcap,
         CASE WHEN b.ticker IS NULL THEN 'no_bars'
              WHEN last_close <= 5 THEN 'penny'
              WHEN price IS NULL THEN 'no_price'
              WHEN r.rsi IS NULL THEN 'rsi_undefined'
              WHEN r.rsi = 0 THEN 'rsi_zero' END AS reason
  FROM (SELECT DISTINCT ticker FROM {universe}) u
  LEFT JOIN {name}_band b USING (ticker)
  LEFT JOIN {name}_last r USING (ticker)
  LEFT JOIN {name}_beta t USING (ticker)
  LEFT JOIN cik_map k USING (ticker)
  LEFT JOIN company c USING (cik))""",
        ]
    )


SNAPSHOT_COLUMNS = "ticker, pct_below_ci, rsi, bm, op, inv, beta, mcap"

INPUTS = ",".join([BARS, UNIVERSE, FILINGS])

SNAPSHOT = ",".join(
    [
        INPUTS,
        evaluation("evaluated", AS_OF, "universe"),
        f"""
snap AS (SELECT {SNAPSHOT_COLUMNS} FROM evaluated WHERE reason IS NULL)""",
    ]
)

MINUTES = """
line_ticks AS (
  SELECT 'S' || l_suppkey AS ticker, l_shipdate AS ts, l_orderkey * 10 + l_linenumber AS seq,
         CAST(round_even((100::DOUBLE
           + round_even(l_extendedprice * 100::DOUBLE, 0) / 100000::DOUBLE)
           * (CASE WHEN l_suppkey % 10 = 7 THEN 0.03::DOUBLE ELSE 1::DOUBLE END)
           * 10000::DOUBLE, 0) AS BIGINT)::DOUBLE / 10000::DOUBLE AS price
  FROM lineitem),
minutes AS (
  SELECT ticker, ts, arg_max(price, seq) AS close FROM line_ticks GROUP BY ticker, ts)"""

HOUR_BARS = f"""
{TICKS},
hour_closes AS (
  SELECT ticker, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_max(price, seq) AS close
  FROM ticks GROUP BY ALL),
bars AS (
  SELECT * FROM hour_closes
  UNION ALL
  SELECT 'MKT', ts,
         round_even(CAST(sum(CAST(round_even(close * 10000::DOUBLE, 0) AS BIGINT))
           AS BIGINT)::DOUBLE / count(*)::DOUBLE, 0) / 10000::DOUBLE
  FROM hour_closes GROUP BY ts)"""

SEQ = "coalesce(try_cast(substr(ticker, 2) AS BIGINT), -1)"

OLD_STORE = ",".join(
    [
        INPUTS,
        LISTING,
        evaluation("earlier", OLD_AS_OF, "universe"),
        f"""
stored AS (
  SELECT {SNAPSHOT_COLUMNS}, {SEQ} AS seq, {OLD_AS_OF} AS as_of
  FROM earlier WHERE reason IS NULL)""",
    ]
)
