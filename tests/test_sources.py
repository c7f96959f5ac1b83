import json
from datetime import datetime, timedelta

import pytest
from builders import AS_OF, BAR, bars, daily
from pyspark.sql import functions as F

from tickerloom.functions.moments import delayed_as_of, lookback_start, utc_instant
from tickerloom import schemas
from tickerloom.operators import accounting
from tickerloom.sources import bars as bar_source
from tickerloom.sources import filings, lists


def test_conform_drops_unusable_closes(spark):
    raw = spark.createDataFrame(
        [("A", AS_OF, 1.0), ("A", AS_OF, float("nan")), ("A", AS_OF, None), (None, AS_OF, 1.0)],
        "ticker STRING, ts TIMESTAMP_NTZ, close DOUBLE",
    )
    kept = bar_source.conform_bars(raw, "daily").collect()
    assert [(r["ticker"], r["freq"], r["close"]) for r in kept] == [("A", "day", 1.0)]


def test_conform_moves_instants_to_utc(spark):
    # in New York, 01:30 on 2024-11-03 happens twice
    instants = ["2024-07-01 04:00:00.25", "2024-11-03 05:30:00", "2024-11-03 06:30:00"]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = ", ".join(f"('A', timestamp'{i} UTC', 1)" for i in instants)
        raw = spark.sql(f"select * from values {rows} as t(ticker, ts, close)")
        bars_ = bar_source.conform_bars(raw, "1D")
        found = [r["ts"] for r in bars_.orderBy("ts").collect()]
        back = bars_.select(utc_instant("ts").alias("ts")).exceptAll(raw.select("ts"))
        lost = back.count()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found == [datetime.fromisoformat(i) for i in instants] and lost == 0


def test_key_violations(spark):
    frame = bars(spark, daily("A", [1, 2]), daily("A", [3]))
    found = bar_source.bar_key_violations(frame).collect()
    assert [(r["ticker"], r["ts"], r["n"]) for r in found] == [("A", AS_OF, 2)]


def test_scan(spark):
    frame = bars(spark, daily("A", range(10)), daily("B", range(10))).withColumn(
        "freq", F.when(F.col("ticker") == "A", "day").otherwise("hour")
    )
    assert bar_source.scan_bars(frame, AS_OF, 3).count() == 8
    assert bar_source.scan_bars(frame, AS_OF, 3, "1H").count() == 4
    assert bar_source.scan_bars(frame, AS_OF, 3, tickers=["A"]).count() == 4
    names = spark.createDataFrame([("A",), ("A",), ("Z",)], "ticker STRING")
    assert bar_source.scan_bars(frame, AS_OF, 3, tickers=names).count() == 4
    assert bar_source.scan_bars(frame, AS_OF, 0.5).count() == 2


def test_moments():
    assert delayed_as_of(datetime(2024, 1, 1, 0, 10)) == datetime(2023, 12, 31, 23, 50)
    assert lookback_start(datetime(2024, 1, 2), 0.5) == datetime(2024, 1, 1, 12)


def test_bars_are_stored_for_pruning(spark, tmp_path):
    path = str(tmp_path / "bars")
    frame = bars(spark, daily("A", range(400)), daily("B", range(400)))
    bar_source.write_bars(frame.withColumn("freq", F.lit("day")), path)
    again = bar_source.read_bars(spark, path)
    assert again.count() == 800
    recent = bar_source.read_bars(spark, path, AS_OF, 30)
    window = bar_source.scan_bars(recent, AS_OF, 30, "daily", tickers=["A"])
    assert window.count() == 31
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = window._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "month" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "GreaterThanOrEqual(ts" in scan and "EqualTo(ticker,A)" in scan
    assert "ReadSchema: struct<ticker:string,ts:timestamp_ntz,close:double>" in scan


@pytest.mark.parametrize("file_format", ["csv", "json", "orc", "parquet"])
def test_raw_bar_files(spark, tmp_path, file_format):
    path = str(tmp_path / "raw")
    bars(spark, daily("A", [1.5, 2.5])).write.format(file_format).save(path)
    read = bar_source.read_raw_bars(spark, path, file_format, "1Min")
    assert [tuple(r) for r in read.orderBy("ts").collect()] == [
        ("A", "minute", AS_OF - timedelta(days=1), 1.5),
        ("A", "minute", AS_OF, 2.5),
    ]


def test_ticker_lists(spark, tmp_path):
    (tmp_path / "sectors").mkdir()
    (tmp_path / "big.txt").write_text("\n".join(f"T{chr(65 + i)}" for i in range(14)))
    (tmp_path / "sectors" / "x.txt").write_text("brk.b;BF.b, brk.b")
    everything = lists.read_ticker_lists(spark, str(tmp_path))
    assert {r["list"] for r in lists.list_names(everything).collect()} == {"big.txt", "x.txt"}
    assert lists.read_ticker_lists(spark, f"{tmp_path}/*.txt", recursive=False).count() == 1
    rows = lists.parse_tickers(everything).where("list = 'x.txt'").orderBy("ordinal").collect()
    assert [(r["ordinal"], r["ticker"]) for r in rows] == [(0, "BRK.B"), (1, "BF.B"), (2, "BRK.B")]
    sizes = {r["list"]: r.asDict() for r in lists.list_overview(everything).collect()}
    assert sizes["big.txt"]["n_tickers"] == 14 and sizes["big.txt"]["n_more"] == 2
    assert sizes["big.txt"]["first_tickers"].endswith("TL")
    assert sizes["x.txt"]["n_more"] == 0


def test_cik_dimension_last_entry_wins(spark, tmp_path):
    document = {
        "0": {"cik_str": 1, "ticker": "aapl", "title": "x"},
        "1": {"cik_str": 2, "ticker": "MSFT", "title": "y"},
        "2": {"cik_str": 3, "ticker": "AAPL", "title": "z"},
    }
    (tmp_path / "map.json").write_text(json.dumps(document))
    found = filings.cik_dimension(filings.read_documents(spark, str(tmp_path)))
    assert {r["ticker"]: r["cik"] for r in found.collect()} == {
        "AAPL": "0000000003",
        "MSFT": "0000000002",
    }


def test_facts_from_files(spark, tmp_path):
    def entry(end, val, **more):
        return {"end": end, "val": val, "filed": "2023-02-01", "form": "10-K", **more}

    document = {
        "cik": 7,
        "entityName": "Seven",
        "facts": {
            "dei": {"Float": {"units": {"USD": [entry("2022-12-31", 1)]}}},
            "us-gaap": {
                "StockholdersEquity": {
                    "label": "x",
                    "units": {
                        "USD": [
                            entry("2022-12-31", 50, start="2022-01-01"),
                            entry("2022-12-31", 60),
                        ]
                    },
                },
                "Other": {"units": {"EUR": [entry("2022-12-31", 9)]}},
            },
        },
    }
    (tmp_path / "CIK0000000007.json").write_text(json.dumps(document))
    (tmp_path / "CIK0000000008.json").write_text(json.dumps({"facts": document["facts"]}))
    (tmp_path / "CIK0000000009.json").write_text(json.dumps(document)[:80])
    (tmp_path / "other.json").write_text(json.dumps({"facts": {}}))
    every = filings.read_documents(spark, str(tmp_path))
    lost = {r["doc"].rsplit("/", 1)[1]: r["reason"] for r in filings.unparsed_documents(every).collect()}
    assert lost == {"CIK0000000009.json": "malformed", "other.json": "no_cik"}
    companies = {r["cik"] for r in filings.flatten_facts(every).select("cik").distinct().collect()}
    assert companies == {"0000000007", "0000000008"}  # the second only has it in its name
    documents = every.where("doc like '%07.json'")
    everything = filings.flatten_facts(documents)
    assert everything.count() == 4
    assert filings.flatten_facts(documents, taxonomy="dei").count() == 1
    named = filings.flatten_facts(documents, concepts=accounting.ACCOUNTING_CONCEPTS)
    wanted = everything.where("concept = 'StockholdersEquity'")
    assert sorted(map(repr, named.collect())) == sorted(map(repr, wanted.collect()))
    row = accounting.company_values(named).first()
    assert (row["cik"], row["equity"]) == ("0000000007", 50.0)


def test_stored_facts_come_back_and_prune(spark, tmp_path):
    rows = [(f"{c:010d}", "us-gaap", "Assets", "USD", p, "2023-12-31", "2024-02-01", "10-K", float(p))
            for c in range(5) for p in range(3)]
    facts = spark.createDataFrame(rows, schemas.FACTS)
    path = str(tmp_path / "facts")
    filings.write_facts(facts, path)
    stored = filings.read_facts(spark, path)
    assert sorted(map(repr, stored.collect())) == sorted(map(repr, facts.collect()))
    plan = stored.where("cik = '0000000003'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(cik,0000000003)" in plan


def test_each_call_prunes_to_its_own_months(spark, tmp_path):
    path = str(tmp_path / "bars")
    table = spark.createDataFrame(
        [("A", "day", datetime(2024, m, 5), float(m)) for m in range(1, 7)], schemas.BARS
    )
    bar_source.write_bars(table, path)
    read = bar_source.bar_reader(spark, path, "1D")
    for month in (6, 4):
        found = read(datetime(2024, month, 28), 40)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "month#" in plan and f"2024-0{month})" in plan.split("PartitionFilters")[1]
        assert {r["close"] for r in found.collect()} == {float(month), float(month - 1)}


def test_lists_of_one_name_in_two_folders_stay_apart(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "tech.txt").write_text(f"{folder}x\n{folder}y")
    everything = lists.read_ticker_lists(spark, str(tmp_path))
    assert lists.list_names(everything).count() == 2
    by_path = {}
    for r in lists.parse_tickers(everything).collect():
        by_path.setdefault(r["path"][-10:], []).append((r["ordinal"], r["ticker"]))
    assert by_path == {"a/tech.txt": [(0, "AX"), (1, "AY")], "b/tech.txt": [(0, "BX"), (1, "BY")]}
    lines = lists.parse_lines(lists.read_list_lines(spark, str(tmp_path)), ["list", "path"])
    assert sorted(lines.select("path", "ordinal", "ticker").collect()) == sorted(
        lists.parse_tickers(everything).select("path", "ordinal", "ticker").collect()
    )


def test_one_large_file_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "large.txt").write_text("\n".join(f"t{chr(97 + i % 26)};{'x' * (i % 7)}, , {i}" for i in range(40_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        lines = lists.read_list_lines(spark, str(tmp_path))
        assert lines.select("block").distinct().count() > 5
        mine = {(r.ordinal, r.ticker) for r in lists.parse_lines(lines).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = lists.parse_tickers(lists.read_ticker_lists(spark, str(tmp_path)))
    assert mine == {(r.ordinal, r.ticker) for r in whole.collect()} and len(mine) > 70_000


def merge_table(spark, tmp_path):
    path = str(tmp_path / "bars")
    first = [("A", datetime(2024, m, d), float(d)) for m in (1, 2, 3) for d in (1, 2, 3)]
    frame = spark.createDataFrame(first, BAR).withColumn("freq", F.lit("day"))
    bar_source.write_bars(frame, path)
    return path, {(t, ts): close for t, ts, close in first}


CHANGE = "ticker STRING, ts TIMESTAMP_NTZ, close DOUBLE, load INT"


def merged_rows(spark, path):
    return {(r.ticker, r.ts): r.close for r in bar_source.read_bars(spark, path).collect()}


def test_merge_rewrites_touched_months_only(spark, tmp_path):
    path, expected = merge_table(spark, tmp_path)
    files = {m: sorted(str(f) for f in (tmp_path / "bars" / "freq=day" / f"month=2024-{m}").glob("*.parquet")) for m in ("01", "02", "03")}
    changes = [
        ("A", datetime(2024, 2, 2), 20.0, 1), ("A", datetime(2024, 2, 2), 21.0, 3), ("A", datetime(2024, 2, 2), 22.0, 2),
        ("A", datetime(2024, 2, 3), None, 1), ("B", datetime(2024, 2, 9), 9.0, 1), ("C", datetime(2024, 4, 1), 4.0, 1),
        ("Z", datetime(2024, 4, 2), None, 1),
    ]
    frame = spark.createDataFrame(changes, CHANGE).withColumn("freq", F.lit("day"))
    expected |= {("A", datetime(2024, 2, 2)): 21.0, ("B", datetime(2024, 2, 9)): 9.0, ("C", datetime(2024, 4, 1)): 4.0}
    del expected["A", datetime(2024, 2, 3)]
    for _ in range(2):  # a repeated merge changes nothing
        assert bar_source.merge_bars(spark, path, frame) == ["2024-02", "2024-04"]
        assert merged_rows(spark, path) == expected
    after = {m: sorted(str(f) for f in (tmp_path / "bars" / "freq=day" / f"month=2024-{m}").glob("*.parquet")) for m in files}
    assert after["01"] == files["01"] and after["03"] == files["03"] and after["02"] != files["02"]


def test_merge_may_empty_a_month_or_do_nothing(spark, tmp_path):
    path, expected = merge_table(spark, tmp_path)
    gone = [("A", datetime(2024, 1, d), None, 1) for d in (1, 2, 3)]
    frame = spark.createDataFrame(gone, CHANGE).withColumn("freq", F.lit("day"))
    assert bar_source.merge_bars(spark, path, frame.where("false")) == []
    assert bar_source.merge_bars(spark, path, frame) == ["2024-01"]
    assert merged_rows(spark, path) == {k: v for k, v in expected.items() if k[1].month != 1}


def test_facts_and_faults_from_one_parse(spark):
    entry = '{"end":"2023-12-31","filed":"2024-02-01","form":"10-K","val":%s}'
    gaap = '{"us-gaap":{"Assets":{"units":{"USD":[' + entry % "1.5" + "," + entry % "2" + ']}},"Empty":{"units":{}}},"dei":{"X":{"units":{"pure":[' + entry % "null" + "]}}}}"
    documents = [
        ("a", '{"cik":7,"facts":' + gaap + "}"), ("CIK0000000012.json", '{"facts":' + gaap + "}"), ("c", '{"facts":' + gaap + "}"),
        ("d", '{"cik":"9","facts":{}}'), ("e", '{"cik":9}'), ("f", ""), ("g", None), ("h", '{"cik":7,"facts":' + gaap[:-9]),
        ("i", '{"cik":7,"facts":[1,2]}'), ("j", '[]'), ("k", '{"cik":7,"facts":null}'),
    ]
    frame = spark.createDataFrame(documents, "doc STRING, json STRING")
    found = filings.facts_and_faults(frame).collect()
    facts = sorted((r.doc, r.cik or "", r.concept, r.unit, r.pos, r.end, r.filed, r.form, r.val or 0) for r in found if r.pos is not None)
    plain = filings.flatten_facts(frame.where("doc in ('a', 'CIK0000000012.json', 'c')"), keep=("doc",)).collect()
    assert facts == sorted((r.doc, r.cik or "", r.concept, r.unit, r.pos, r.end, r.filed, r.form, r.val or 0) for r in plain)
    faults = {(r.doc, r.reason) for r in found if r.reason}
    want = {(r.doc, r.reason) for r in filings.unparsed_documents(frame.where("doc not in ('i', 'j')")).collect()}
    assert faults - {("i", "no_facts"), ("j", "no_facts")} == want and len(faults) == len(want) + 2
