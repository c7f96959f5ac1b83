from datetime import datetime

from pyspark.sql import functions as F

from tickerloom.functions.moments import moment_literal
from tickerloom.operators.resample import resample
from tickerloom.plans import views
from tickerloom.streaming.ticks import stream_bars, stream_latest_price


def stream_of(spark, sf_dir, tmp_path):
    """The ticks as a stream of files that arrive in time order."""
    source = str(tmp_path / "ticks")
    ticks = views.ticks(spark, sf_dir)
    bounds = ticks.agg(F.min("ts"), F.max("ts")).first()
    step = (bounds[1] - bounds[0]) / 4
    for k in range(4):
        start, end = bounds[0] + k * step, bounds[0] + (k + 1) * step
        part = (F.col("ts") >= moment_literal(start)) & (F.col("ts") < moment_literal(end))
        if k == 3:
            part = F.col("ts") >= moment_literal(start)
        ticks.where(part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1)
    return ticks, stream.parquet(source)


def run(frame, mode, name, tmp_path):
    query = (
        frame.writeStream.outputMode(mode)
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", str(tmp_path / f"checkpoint-{name}"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    return frame.sparkSession.table(name)


def test_closed_bars_equal_the_batch(spark, sf_dir, tmp_path):
    ticks, stream = stream_of(spark, sf_dir, tmp_path)
    closed = run(stream_bars(stream, "daily", "1 hour"), "append", "closed_bars", tmp_path)
    batch = {tuple(r) for r in resample(ticks, "daily").collect()}
    streamed = [tuple(r) for r in closed.collect()]
    last_day = ticks.agg(F.max(F.to_date("ts"))).first()[0]
    assert set(streamed) <= batch and len(streamed) == len(set(streamed))
    assert {r for r in batch if r[1].date() < last_day} <= set(streamed)


def test_latest_price(spark, sf_dir, tmp_path):
    ticks, stream = stream_of(spark, sf_dir, tmp_path)
    prices = run(stream_latest_price(stream), "complete", "latest_prices", tmp_path)
    batch = ticks.groupBy("ticker").agg(F.max_by("price", "ts"), F.max("ts"))
    assert {tuple(r) for r in prices.collect()} == {tuple(r) for r in batch.collect()}


def test_bars_of_ticks_ignore_missing_prices(spark):
    rows = [("A", datetime(2024, 1, 1, 9, m), p) for m, p in ((0, float("nan")), (1, 3.0), (2, 5.0), (3, None), (4, float("nan")))]
    ticks = spark.createDataFrame(rows, "ticker string, ts timestamp_ntz, price double")
    bar = resample(ticks, "daily").first()
    assert (bar["open"], bar["high"], bar["low"], bar["close"], bar["n_ticks"]) == (3.0, 5.0, 3.0, 5.0, 2)
    assert stream_latest_price(ticks).first()["price"] == 5.0
