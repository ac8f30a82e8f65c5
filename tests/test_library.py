"""Edge rows, storage, plans and variants."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from haulgrid.functions.labels import AIR_QUALITY, PM25_BANDS, TEMPERATURES, band, weather_label
from haulgrid.operators import columns, integrate, validate
from haulgrid.operators.ingest import conform, ingest
from haulgrid.plans import analytics, bindings, city, datasets, products, tuning
from haulgrid.session import settings
from haulgrid.sources import readers
from haulgrid.sources.lake import Lake, readable
from haulgrid.streaming import incremental

DATA = "/root/testdata/sf0.001"
TRIP = "id int, pickup_datetime timestamp_ntz, dropoff_datetime timestamp_ntz, trip_distance double, fare_amount double, passenger_count int"
A, B = datetime(2024, 1, 1, 5), datetime(2024, 1, 1, 6)


def trip(n, start=A, end=B, distance=1.0, fare=1.0, people=1):
    return (n, start, end, distance, fare, people)


def reasons(spark, rows, **spec):
    s = validate.DatasetSpec("x", timestamps=("pickup_datetime", "dropoff_datetime"), rule=validate.trip_rule, **spec)
    return [r[validate.REASON] for r in validate.tag(spark.createDataFrame(rows, TRIP), s).orderBy("id", "fare_amount").collect()]


def test_one_reason_each(spark):
    rows = [trip(1), trip(2, distance=None), trip(3, people=None), trip(4, start=B, end=A), trip(5, fare=-1.0), trip(6, distance=0.0), trip(7, end=A, fare=0.0), trip(8, end=None)]
    bad = validate.RULE
    assert reasons(spark, rows) == [None, bad, bad, bad, bad, bad, None, validate.BAD_TIME]


def test_order_of_reasons(spark):
    rows = [trip(None, start=None), trip(1, fare=1.0), trip(1, fare=2.0), trip(1, fare=-1.0), trip(2, end=None), trip(2)]
    key = {"primary_key": ("id",), "first_by": ("fare_amount",)}
    want = [validate.NULL_KEY, validate.RULE, validate.DUPLICATE, validate.DUPLICATE, validate.BAD_TIME, None]
    assert sorted(map(str, reasons(spark, rows, **key))) == sorted(map(str, want))
    assert reasons(spark, [trip(1), trip(1)]) == [None, None]


def test_labels_at_borders(spark):
    def of(values, f):
        return [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").orderBy("k").select(f(F.col("v"))).collect()]

    assert of([-1.0, 0.0, 1.0, 16.0, 17.0, None], lambda v: weather_label(v.cast("int"))) == ["Unknown", "Unknown", "Clear", "Heavy Snowfall", "Unknown", "Unknown"]
    assert of([9.99, 10.0, 20.0, 30.0, 50.0], lambda v: band(v, PM25_BANDS)) == [x for _, x in PM25_BANDS]
    assert of([4.99, 5.0, 19.99, 20.0], lambda v: band(v, TEMPERATURES)) == [TEMPERATURES[k][1] for k in (0, 1, 1, 2)]
    assert of([12.0, 12.01, 35.4, 55.4, 150.4, 250.4, 250.41], lambda v: band(v, AIR_QUALITY, True)) == [AIR_QUALITY[k][1] for k in (0, 1, 1, 2, 3, 4, 5)]


def test_columns(spark):
    df = spark.createDataFrame([("  a ", None, "5", "xx"), ("", None, "b", "2024-01-01 05:00:00")], "s string, e string, i string, t string")
    assert [r.s for r in columns.trim_text(df).collect()] == ["a", ""]
    assert "e" not in columns.drop_empty(df).columns and "e" in columns.drop_empty(df, keep=("e",)).columns
    assert columns.drop_empty(df.limit(0)).columns == df.columns
    assert [r.i for r in columns.to_int(df, ["i"]).collect()] == [5, None]
    assert [r.t for r in columns.to_timestamps(df, ["t"]).collect()] == [None, A]
    with pytest.raises(ValueError, match="missing columns: p, q"):
        columns.require(df, ["s", "q", "p"])
    with pytest.raises(ValueError, match="unknown format"):
        readers.load(spark, "x", "xml")


def test_csv_and_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y\n")
    assert readers.load(spark, str(tmp_path / "a.csv"), "csv").schema.simpleString() == "struct<id:int,name:string>"
    assert readers.load(spark, str(tmp_path / "a.csv"), "csv", "id string, name string").dtypes[0] == ("id", "string")
    assert readers.peek(spark, str(tmp_path / "a.csv"), "csv", 1).count() == 1
    assert readers.rows(spark, [(1,)], "a int").first().a == 1


def test_lake(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    df = spark.createDataFrame([(1, 2023), (2, 2024)], "a int, year int")
    lake.replace(df, "silver", "t", ("year",))
    lake.replace(lake.read("silver", "t").withColumn("b", F.lit(1)), "silver", "t", ("year",))  # from itself, with another schema
    assert lake.read("silver", "t").count() == 2
    assert "PartitionFilters: [isnotnull(year" in tuning.plan_text(lake.read("silver", "t").where("year = 2024"))
    lake.replace_partitions(spark.createDataFrame([(9, 1, 2024)], "a int, b int, year int"), "silver", "t", ("year",))
    assert sorted(r.a for r in lake.read("silver", "t").collect()) == [1, 9]
    assert lake.size("silver", "t")[1] >= 2 and readable(2048) == "2.00 KB"


def test_ingest_and_conform(spark, tmp_path):
    raw = spark.createDataFrame([(1, "2024-01-01 05:00:00", " x ", "7", None), (1, "2024-01-01 05:00:00", "y", "8", None), (2, "bad", "z", "q", None)], "ID int, at string, s string, code string, gone string")
    raw.write.parquet(str(tmp_path / "raw"))
    spec = validate.DatasetSpec("d", str(tmp_path / "raw"), renames={"ID": "id"}, required=("id", "at"), primary_key=("id",), first_by=("s",), timestamps=("at",), partition_source="at")
    lake = Lake(spark, str(tmp_path / "lake"))
    entry = ingest(lake, spec)
    assert (entry["processed_records"], entry["accepted_records"], entry["rejected_records"]) == (3, 1, 2)
    assert {r.rejection_reason for r in lake.read("rejected", "d").collect()} == {validate.DUPLICATE, validate.BAD_TIME}
    raw.limit(1).write.mode("overwrite").parquet(str(tmp_path / "raw"))
    ingest(lake, spec)
    assert lake.read("rejected", "d").count() == 0 and lake.read("metadata", "ingestion_log").count() == 2
    conform(lake, spec, ints=("code",), values={"code": -1})
    row = lake.read("silver", "d").first()
    assert row.s == "x" and row.code == 7 and "gone" not in row


def test_hourly_context_is_single(spark):
    weather = spark.createDataFrame([(A, None, 1), (A, 3.0, 2), (B, 1.0, 3)], "weather_hour timestamp_ntz, temp double, condition_code int")
    trips = spark.createDataFrame([trip(1), trip(2, start=datetime(2024, 1, 2))], TRIP)
    got = integrate.with_hourly(integrate.with_hour(trips), integrate.hourly_weather(weather), "weather_hour").orderBy("id").collect()
    assert [(r.id, r.temp) for r in got] == [(1, 3.0), (2, None)]


def test_products_keep_their_creation(spark, tmp_path):
    lake, gold = Lake(spark, str(tmp_path)), bindings.gold(spark, DATA)
    first, second = datetime(2024, 1, 1), datetime(2024, 2, 1)
    n = products.refresh(lake, gold, "zone_statistics", clock=lambda: first)
    assert products.refresh(lake, gold, "zone_statistics", clock=lambda: second) == n
    row = lake.read("products", "zone_statistics").first()
    assert (row.creation_time, row.refresh_time, row.schema_version) == (first, second, "1.0")


def test_variants_agree_and_settings_return(spark):
    trips, zones = bindings.sales_trips(spark, DATA), bindings.zones(spark, DATA)
    on = trips["pickup_location_id"] == zones["location_id"]
    plain = lambda: trips.join(zones.hint("merge"), on).groupBy("zone").count()
    hinted = lambda: trips.join(F.broadcast(zones), on).groupBy("zone").count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    assert tuning.broadcast_experiment(spark, plain, hinted)["same"]
    assert tuning.adaptive_experiment(spark, plain)["same"]
    assert tuning.caching_experiment(spark, trips, lambda df: df.groupBy("year").count())["same"]
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    assert "BroadcastHashJoin" in tuning.plan_text(hinted())
    with pytest.raises(RuntimeError), settings(spark, {"spark.sql.adaptive.enabled": "false"}):
        raise RuntimeError
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_storage_and_pruning(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    out = tuning.storage_experiment(lake, bindings.sales_trips(spark, DATA), ("year",), {"days": analytics.duration_per_day})
    assert out["partitioned"]["files"] >= 1 and out["flat"]["bytes"] > 0
    assert tuning.pruning_experiment(lake, "benchmark", "partitioned", 1998)["same"]


TRIP_RAW = "VendorID int, tpep_pickup_datetime timestamp_ntz, tpep_dropoff_datetime timestamp_ntz, passenger_count double, trip_distance double, RatecodeID double, store_and_fwd_flag string, PULocationID int, DOLocationID int, payment_type long, fare_amount double, total_amount double, Airport_fee double"


def raw_files(spark, raw):
    """Raw files of all four datasets: hours of two months, with rows that must be rejected."""
    at = lambda month, day, hour: datetime(2024, month, day, hour, 20)
    trips = [(1, at(m, d, h), at(m, d, h + 1), 1.0, float(h + 1), 1.0, " N ", 1 + h % 3, 2, 1, 10.0, 12.5, None) for m in (1, 2) for d in (1, 2, 3) for h in range(6)]
    trips += [(1, at(1, 1, 5), at(1, 1, 4), 1.0, 1.0, 1.0, "N", 1, 2, 1, 1.0, 1.0, None), (1, None, at(1, 1, 4), 1.0, 1.0, 1.0, "N", 1, 2, 1, 1.0, 1.0, None)]
    spark.createDataFrame(trips, TRIP_RAW).write.parquet(f"{raw}/taxi_trips")
    (raw / "weather").mkdir()
    lines = ["year,month,day,hour,temp,temp_source,rhum,prcp,wdir,wspd,pres,coco,snwd,snwd_source"]
    lines += [f"2024,{m},{d},{h},{h - 2}.5,x,50,{'' if h == 3 else 0.2},10,3.5,1000,{'' if h == 4 else 1 + h},," for m in (1, 2) for d in (1, 2) for h in range(6)] + ["2024,1,1,25,1,x,50,0,1,1,1,1,,", "2024,1,1,0,9,x,50,0,1,1,1,1,,"]
    (raw / "weather" / "w.csv").write_text("\n".join(lines))
    (raw / "air_quality").mkdir()
    lines = ["State Code,County Code,Site Num,Parameter Code,POC,Date Local,Time Local,Sample Measurement,Date GMT,Time GMT,Uncertainty"]
    lines += [f"36,81,{site},88101,{poc},2024-01-0{d},0{h}:00,{h + poc}.0,2024-01-0{d},0{h}:00," for site in (124, 125) for poc in (1, 3) for d in (1, 2) for h in range(6)] + ["36,81,124,88101,9,2024-01-01,01:00,,2024-01-01,01:00,"]
    (raw / "air_quality" / "a.csv").write_text("\n".join(lines))
    (raw / "taxi_zones").mkdir()
    (raw / "taxi_zones" / "z.csv").write_text("LocationID,Borough,Zone,service_zone\n1,Queens, Astoria ,Boro\n2,Bronx,Belmont,Boro\n0,x,x,x\n2,Bronx,Other,Boro\n")


def test_from_raw_files_to_products(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    raw_files(spark, raw)
    lake = Lake(spark, str(tmp_path / "lake"))
    log = {e["dataset"]: (e["processed_records"], e["rejected_records"]) for e in city.ingest_all(lake, str(raw))}
    assert log == {"taxi_trips": (38, 2), "weather": (26, 2), "air_quality": (49, 1), "taxi_zones": (4, 2)}
    why = {name: sorted(r.rejection_reason for r in lake.read("rejected", name).collect()) for name in datasets.DATASETS}
    assert why["taxi_trips"] == sorted([validate.RULE, validate.BAD_TIME]) and why["air_quality"] == [validate.RULE]
    assert why["weather"] == why["taxi_zones"] == sorted([validate.RULE, validate.DUPLICATE])
    city.build_silver(lake)
    silver = {name: lake.read("silver", name) for name in datasets.DATASETS}
    assert "airport_fee" not in silver["taxi_trips"].columns and dict(silver["taxi_trips"].dtypes)["rate_code_id"] == "int"
    assert not {"snwd", "snwd_source"} & set(silver["weather"].columns) and silver["weather"].where("condition_code = -1").count() == 4
    assert "aq_timestamp" in silver["air_quality"].columns and not {"time_local", "date_gmt", "uncertainty"} & set(silver["air_quality"].columns)
    gold = city.build_gold(lake)
    assert gold.count() == 36 and gold.columns[-2:] == ["year", "month"]
    names = {"pickup_hour", *city.CONTEXT, "pm25_hourly_avg", *[f"{r}_{c}" for r in ("pickup", "dropoff") for c in ("zone", "borough", "service_zone")]}
    assert names <= set(gold.columns)
    row = gold.where("pickup_datetime = timestamp_ntz'2024-01-02 03:20:00'").first()
    assert (row.temp, row.precipitation, row.condition_code, row.pm25_hourly_avg, row.pickup_zone, row.dropoff_zone) == (1.5, 0.0, 4, 5.0, "Astoria", "Belmont")
    assert gold.where("day(pickup_datetime) = 3 AND temp IS NULL AND pm25_hourly_avg IS NULL").count() == 12
    city.register(lake)
    assert {"trips", "zone_lookup"} <= {r.tableName for r in city.tables(spark).collect()}
    assert [tuple(r) for r in spark.sql("SELECT month AS m, count(*) FROM trips GROUP BY m ORDER BY m").collect()] == [(1, 18), (2, 18)]
    plan = tuning.plan_text(analytics.monthly_demand(lake.read("gold", city.GOLD), 2023))
    assert "PartitionFilters: [isnotnull(year" in plan
    assert city.refresh_products(lake)["daily_mobility"] == lake.read("products", "daily_mobility").count()
    assert analytics.zone_variance_top(lake.read("products", "zone_weather_stats")).count() == lake.read("products", "zone_weather_stats").count()
    share = city.product_share(lake)
    assert share["share_pct"] == round(100 * sum(share[n] for n in products.PRODUCTS) / share[city.GOLD], 2)
    detail = lake.detail("gold", city.GOLD)
    assert detail["partition_columns"] == ["year", "month"] and detail["num_files"] == 2 and detail["size_in_bytes"] > 0
    assert set(city.time_queries(lake, {"peak": analytics.peak_hours}, 2)) == {"peak"}


def test_command_line(spark, tmp_path, capsys):
    from haulgrid.__main__ import main

    raw = tmp_path / "raw"
    raw.mkdir()
    raw_files(spark, raw)
    where = ["--base", str(tmp_path / "lake"), "--raw", str(raw)]
    for step in ("all", "profile", "benchmark", "sql"):
        main([step, *where])
    out = capsys.readouterr().out
    assert "taxi_zones" in out and "share_pct" in out and "peak_hours" in out and "null_pct" in out


def test_hourly_sides_are_broadcast_at_any_size(spark, tmp_path):
    """The optimizer's estimate of a stored side is its size, not that of what it was made from."""
    from haulgrid.operators.integrate import lookup

    lake = Lake(spark, str(tmp_path))
    many = spark.range(2_000_000).select((F.timestamp_seconds(F.col("id") % 50 * 3600).cast("timestamp_ntz")).alias("weather_hour"), F.rand(1).alias("temp"))
    made = integrate.hourly_weather(many)
    kept = lake.stored(made, "silver", "hourly_weather")
    assert "isBroadcastable" not in tuning.plan_text(lookup(made)) and kept.count() == 50
    assert "strategy=broadcast" in tuning.plan_text(lookup(kept))


def test_replace_keeps_a_whole_table(spark, tmp_path, monkeypatch):
    lake = Lake(spark, str(tmp_path))
    lake.replace(spark.range(3), "silver", "t")
    real = Lake._fs

    class Broken:
        def __init__(self, fs):
            self.fs = fs

        def rename(self, a, b):
            return False if ".stage-" in a.toString() else self.fs.rename(a, b)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    monkeypatch.setattr(Lake, "_fs", lambda self, path: (Broken(real(self, path)[0]), *real(self, path)[1:]))
    with pytest.raises(OSError, match="could not become"):
        lake.replace(spark.range(9), "silver", "t")
    monkeypatch.undo()
    assert lake.read("silver", "t").count() == 3


def test_plans(spark):
    """Bounds of dates reach the scan, only roles that are asked for are joined, and the join without a hint is a merge."""
    from haulgrid.plans.queries import QUERIES

    text = tuning.plan_text(QUERIES["monthly_demand"](spark, DATA))
    assert "GreaterThanOrEqual(o_orderdate" in text and "supplier" not in text
    assert "GreaterThanOrEqual(o_orderdate" in tuning.plan_text(QUERIES["pruned_counts"](spark, DATA))
    assert "SortMergeJoin" in tuning.plan_text(QUERIES["zone_join_no_hint"](spark, DATA)) and "SortMergeJoin" not in tuning.plan_text(QUERIES["zone_join_broadcast"](spark, DATA))


def test_differences_count_repetitions(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (2,)], "x int")
    assert validate.differences(a, b) == (1, 0)


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([trip(1), trip(2, distance=None)], TRIP)
    df.write.parquet(str(tmp_path / "in"))
    spec = validate.DatasetSpec("t", timestamps=("pickup_datetime",), rule=validate.trip_rule)
    lake = Lake(spark, str(tmp_path / "lake"))
    for _ in range(2):  # the second run finds nothing new
        incremental.ingest_stream(lake, spec, incremental.stream(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "state")).awaitTermination()
    assert lake.read("bronze", "t").count() == 1 and lake.read("rejected", "t").count() == 1
    keyed = validate.DatasetSpec("k", primary_key=("id",), first_by=("fare_amount",), timestamps=("pickup_datetime",), partition_source="pickup_datetime", rule=validate.trip_rule)
    for k, rows in enumerate(([trip(1), trip(2, distance=None)], [trip(1, fare=3.0), trip(2), trip(3), trip(3)])):  # an accepted key comes again, a rejected one may
        spark.createDataFrame(rows, TRIP).write.mode("append").parquet(str(tmp_path / "keyed"))
        incremental.ingest_stream(lake, keyed, incremental.stream(spark, str(tmp_path / "keyed"), df.schema), str(tmp_path / "state-k")).awaitTermination()
    assert sorted((r.id, r.year, r.batch) for r in lake.read("bronze", "k").collect()) == [(1, 2024, 0), (2, 2024, 1), (3, 2024, 1)]
    assert sorted((r.id, r.rejection_reason) for r in lake.read("rejected", "k").collect()) == [(1, validate.DUPLICATE), (2, validate.RULE), (3, validate.DUPLICATE)]
    counts = incremental.windowed_counts(incremental.stream(spark, str(tmp_path / "in"), df.schema).withColumn("at", F.col("pickup_datetime").cast("timestamp")), "at", "1 hour", "10 minutes")
    q = counts.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").first().n == 2
