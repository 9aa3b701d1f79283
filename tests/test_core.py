"""Golden values of operators, dialect, sources and streaming; and every query against its SQL."""

import math
import uuid

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__
from tickspark import queries
from tickspark.frame import TickFrame
from tickspark.functions import scalars as fn
from tickspark.operators import bars, joins, relational, windows
from tickspark.plans import ddl, dialect
from tickspark.sources import feeds, store
from tickspark.sources.tables import ticks, trades
from tickspark.streaming import bars as streaming

# The small inputs and results written out in this file's cases are those that results must equal.


def by():
    return Window.partitionBy("k").orderBy("t")


def series(spark, values, key=1):
    return spark.createDataFrame([(key, i, v) for i, v in enumerate(values)], "k long, t long, v long")


def column(df, name):
    return [r[0] for r in df.orderBy("k", "t").select(name).collect()]


@pytest.fixture(scope="module")
def fixture(spark):
    rows = [(1, i, 15000 + 10 * i, 100 + i, i) for i in range(10)] + [(2, i, 20000 + 10 * i, 200 + i, 100 + i) for i in range(5)]
    df = spark.createDataFrame(rows, "symbol long, timestamp long, price long, volume long, seq long")
    df.createOrReplaceTempView("fixture")
    return df


def test_fixture_aggregates(spark, fixture):
    row = dialect.sql(spark, "SELECT sum(volume) AS v, cast(avg(price) AS bigint) AS p, count(*) AS n, first(price) AS a, last(price) AS z FROM fixture WHERE symbol = 1").first()
    assert tuple(row) == (1045, 15045, 10, 15000, 15090)
    assert dialect.sql(spark, "SELECT * FROM fixture WHERE symbol = 1 AND price > 15050").count() == 4
    assert dialect.sql(spark, "SELECT * FROM fixture WHERE symbol = 1 AND price BETWEEN 15020 AND 15050").count() == 4
    assert relational.point_count(fixture, 1, 2, 5).first().n == 4
    assert relational.point_vwap(fixture, 9, 0, 5).first().vwap is None
    assert relational.point_filter_sum(fixture, 1, "volume", 107, 0, 100).first().total == 217
    assert "Scan" in dialect.explain(spark, "SELECT symbol FROM fixture")


@pytest.mark.parametrize(("values", "want"), [([10, 15, 13, 20, 18], [10, 5, -2, 7, -2]), ([100, 110], [100, 10])])
def test_delta(spark, values, want):
    assert column(series(spark, values).withColumn("d", windows.delta("v", by())), "d") == want


@pytest.mark.parametrize(("values", "want"), [([100, 200, 100, 150], [1_000_000, 2_000_000, 500_000, 1_500_000]), ([0, 100, 0], [1_000_000, 0, 0])])
def test_ratio(spark, values, want):
    assert column(series(spark, values).withColumn("d", windows.ratio("v", by())), "d") == want


def test_ema(spark):
    both = series(spark, [10, 20, 30, 40, 50]).union(series(spark, [5, 5], 2)).union(series(spark, [None, 4, None, 8], 3))
    assert column(windows.ema(both, "v", 0.5, ["k"], ["t"]), "ema") == [10, 15, 22, 31, 40, 5, 5, None, 4, 4, 6]
    assert windows.alpha_of(3) == 0.5 and windows.alpha_of(0.2) == 0.2


def test_scalars(spark):
    row = spark.range(1).select(fn.div(F.lit(-7), 2).alias("a"), fn.div(F.lit(7), 0).alias("b"), fn.xbar(F.lit(-7), 5).alias("c"), fn.substr_int(F.lit(-123), 1, 1).alias("d"), fn.substr_int(F.lit(123), 0, 2).alias("e"), fn.substr_int(F.lit(123), 9).alias("f")).first()
    assert tuple(row) == (-3, 0, -5, 0, 12, 0)
    thursday = 1_704_326_400_000_000_000 + 5  # 2024-01-04
    assert spark.range(1).select(fn.date_trunc_ns("week", F.lit(thursday))).first()[0] == thursday - 5


def test_window_join(spark):
    left = spark.createDataFrame([(1, 100), (1, 200), (1, 300), (2, 1000), (None, 100)], "k long, t long")
    right = spark.createDataFrame([(1, 90, 10), (1, 105, 20), (1, 195, 30), (1, 210, 40), (1, 295, 50), (1, 310, 60), (2, 1100, 9)], "k long, t long, v long")
    got = joins.window_join(left, right, ["k"], "t", "t", "v", 15, 15, ["k", "t"]).orderBy("k", "t").collect()
    assert [(r.wj_avg, r.wj_count, r.wj_sum) for r in got] == [(0, 0, 0), (15, 2, 30), (35, 2, 70), (55, 2, 110), (0, 0, 0)]


def test_asof_join(spark):
    left = spark.createDataFrame([(1, 10), (1, 20), (1, 5), (2, 7), (None, 9)], "k long, t long")
    right = spark.createDataFrame([(1, 10, 1, 0), (1, 10, 2, 1), (1, 25, 3, 2), (None, 1, 4, 3)], "k long, t long, v long, seq long")
    got = joins.asof_join(left, right, ["k"], "t", "t", ["v"], ties="seq").collect()
    assert sorted(map(tuple, got)) == [(1, 10, 2), (1, 20, 2)]
    assert joins.asof_join(left, right, ["k"], "t", "t", ["v"], inner=False).count() == 5


def test_asof_slices(spark):
    """Slices of any width give what a search of every right row gives; null keys and times join nothing."""
    left = [(i % 3 or None, (i * 37) % 101 - 20 if i % 11 else None, i) for i in range(60)]
    right = [(i % 4 or None, (i * 29) % 30 * 3 - 15 if i % 13 else None, i) for i in range(60)]
    a = spark.createDataFrame(left, "k long, t long, id long")
    b = spark.createDataFrame(right, "k long, t long, v long")

    def best(k, t, forward, strict):
        near = [(u, v) for q, u, v in right if None not in (k, t, q, u) and q == k and (t < u if forward and strict else t <= u if forward else u < t if strict else u <= t)]
        return (min(near) if forward else max(near))[1] if near else None

    for forward in (False, True):
        for strict in (False, True):
            want = {i: best(k, t, forward, strict) for k, t, i in left}
            for width in (1, 7, 1000):
                got = joins.asof_join(a, b, ["k"], "t", "t", ["v"], ties="v", inner=False, forward=forward, strict=strict, slice_width=width).collect()
                assert len(got) == len(left) and {r.id: r.v for r in got} == want


def test_plus_and_sets(spark):
    left = spark.createDataFrame([(1, 5), (2, 6), (1, 5)], "k long, v long")
    right = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "k long, v long, seq long")
    assert sorted(map(tuple, joins.plus_join(left, right, ["k"], "seq").collect())) == [(1, 25), (1, 25), (2, 6)]
    none = spark.createDataFrame([(None, 1), (None, 1), (3, 3)], "k long, v long")
    assert relational.intersect_keeping(none, none.where("k is null").distinct()).count() == 2
    assert relational.except_keeping(none, none.where("k = 3")).count() == 2


def test_five_minute_bars(spark):
    prices = [100, 110, 105, 115, 108, 200, 210, 205, 215, 208]
    df = spark.createDataFrame([(1, (i // 5) * queries.BAR + i % 5, p, 10 * (i % 5 + 1), i) for i, p in enumerate(prices)], "symbol long, timestamp long, price long, volume long, seq long")
    got = bars.ohlcv(df, queries.BAR).orderBy("bar").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in got] == [(100, 115, 100, 108, 150), (200, 215, 200, 208, 150)]


def test_dialect_rewrites():
    assert dialect.rewrite("SELECT 'first(x)' AS a") == "SELECT 'first(x)' AS a"
    assert dialect.split_arguments("a, f(b, c), ','") == ["a", "f(b, c)", "','"]
    with pytest.raises(ValueError):
        dialect.rewrite("SELECT xbar(a, 5")


def test_ddl(spark):
    for t in ("made", "made__next"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    ddl.execute(spark, "CREATE TABLE made (symbol SYMBOL, timestamp TIMESTAMP_NS, price INT64)")
    ddl.execute(spark, "CREATE TABLE IF NOT EXISTS made (symbol SYMBOL)")
    ddl.execute(spark, "ALTER TABLE made ADD COLUMN volume INT64")
    spark.createDataFrame([(1, h * ddl.HOUR_NS + 5, 1, 1) for h in range(10)], spark.table("made").schema).write.insertInto("made")
    ddl.execute(spark, "ALTER TABLE made DROP COLUMN price")
    assert spark.table("made").columns == ["symbol", "timestamp", "volume"]
    ddl.execute(spark, "ALTER TABLE made SET TTL 3 HOURS", now_ns=9 * ddl.HOUR_NS)
    assert spark.table("made").count() == 4
    with pytest.raises(ValueError):
        ddl.execute(spark, "ALTER TABLE made DROP COLUMN price")
    with pytest.raises(ValueError):
        ddl.spark_type("blob")
    ddl.execute(spark, "DROP TABLE made")


def test_ttl_drops_hours(spark):
    name = f"by_hour_{uuid.uuid4().hex}"
    ddl.execute(spark, f"CREATE TABLE {name} (symbol INT64, note INT32, hour INT64) PARTITIONED BY (hour)")
    spark.sql(f"INSERT INTO {name} SELECT id, 1, id DIV 3 * {ddl.HOUR_NS} FROM range(12)")
    files = lambda: {f for f in spark.table(name).inputFiles()}
    before = files()
    ddl.execute(spark, f"ALTER TABLE {name} SET TTL 2 HOURS", now_ns=4 * ddl.HOUR_NS)
    assert sorted(r.symbol for r in spark.table(name).collect()) == list(range(6, 12)) and files() < before
    ddl.execute(spark, f"ALTER TABLE {name} DROP COLUMN note")
    assert spark.table(name).columns == ["symbol", "hour"] and spark.sql(f"SHOW PARTITIONS {name}").count() == 2
    assert not spark.catalog.tableExists(f"{name}__old") and spark.table(name).count() == 6
    spark.sql(f"DROP TABLE {name}")


def test_store_prunes(spark, small, tmp_path):
    path = str(tmp_path / "ticks")
    all_ticks = ticks(spark, small)
    store.write_ticks(all_ticks, path, buckets=4)
    assert store.read_ticks(spark, path).count() == all_ticks.count()
    one = store.read_ticks(spark, path, symbol=3, start=1_704_240_000_000_000_000, end=1_705_000_000_000_000_000, buckets=4)
    want = all_ticks.where("symbol = 3 and timestamp between 1704240000000000000 and 1705000000000000000")
    assert one.count() == want.count()
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString() or "bucket" in one._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        store.write_ticks(all_ticks, path, compression="rar")
    scaled = store.from_columns(spark.createDataFrame([(1, 1.5, None)], "sym int, price double, volume double"), price_scale=10_000)
    assert scaled.select("price", "volume").first()[:] == (15000, 0)


def test_feeds(spark):
    rows = [('{"symbol_id": 1, "price": 5, "volume": 2, "ts": 9}',), ('{"symbol_id": 1}',), ("junk",), ("",), (None,), ("x" * 5000,)]
    got = feeds.json_ticks(spark.createDataFrame(rows, "value string")).collect()
    assert got[0][:] == (1, 9, 5, 2, None) and [r.reason for r in got[1:]] == ["missing field"] * 4 + ["too long"]
    human = feeds.json_ticks(spark.createDataFrame([('{"symbol": "A", "price": 1.5, "volume": 2, "ts": 9}',)], "value string"), human=True).first()
    assert human.price == 15000 and human.symbol == "A"
    fix = spark.createDataFrame([("8=FIX.4.4\x0135=8\x0155=AAPL\x0131=150.25\x0132=100\x0154=1\x0134=7\x01",), ("35=W\x0155=A\x01132=1.5\x01133=2\x01",), ("35=D\x0155=A\x0144=3\x0138=5\x0137=o=1\x0154=2",), ("nonsense",)], "value string")
    got = feeds.fix_messages(fix).collect()
    assert [r.kind for r in got] == ["tick", "quote", "order", "other"]
    assert (got[0].symbol, got[0].price, got[0].volume, got[0].side, got[0].sequence) == ("AAPL", 150.25, 100, "buy", 7)
    assert (got[1].bid, got[1].ask, got[2].order_id, got[2].side) == (1.5, 2.0, "o=1", "sell")


def test_streams_equal_batches(spark, small, tmp_path):
    batch = trades(spark, small).repartition(4)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.running_bars(stream, queries.BAR).writeStream.outputMode("complete").format("memory").queryName("bars").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.table("bars")) == key(bars.ohlcv(batch, queries.BAR))
    streaming.ingest(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), buckets=2).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()
    sealed = streaming.sealed_bars(stream).writeStream.outputMode("append").format("memory").queryName("sealed").trigger(availableNow=True).start()
    sealed.awaitTermination()
    assert spark.table("sealed").count() <= bars.ohlcv(batch, queries.BAR).count()


def test_frame(spark, fixture):
    frame = TickFrame.of(fixture, 1)
    assert frame.count() == 10 and frame["volume"].sum() == 1045
    assert frame[frame["price"] > 15050]["volume"].sum() == 106 + 107 + 108 + 109
    assert abs(frame.vwap() - sum((15000 + 10 * i) * (100 + i) for i in range(10)) / 1045) < 1e-9
    assert [r.price_mean for r in frame["price"].rolling(2).mean().orderBy("timestamp").limit(2).collect()] == [15000.0, 15005.0]


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) if isinstance(v, float) else v if isinstance(v, (str, bool)) or not hasattr(v, "__int__") else int(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, small, name):
    import duckdb

    c = duckdb.connect()
    for t in ("customer", "events", "lineitem", "orders"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, small), c.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = lambda cursor, names: sorted((tuple(plain(r[names.index(x)]) for x in order) for r in cursor), key=str)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
