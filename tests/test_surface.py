"""The connection, the engine, retention and the SQL lexer."""

import pandas as pd
import pyarrow as pa
import pytest

from tickspark.connect import Connection, Engine, arrow_schema, infer_schema
from tickspark.operators import joins
from tickspark.plans import dialect, foreign, lexer
from tickspark.sources import store

HOUR = 3_600_000_000_000


def test_connection(spark, tmp_path):
    c = Connection(spark, str(tmp_path / "ticks"), "own")
    frame = pd.DataFrame({"sym": [1, 1, 2], "price": [1.5, None, 3.25], "volume": [10, 20, 30], "at": pd.to_datetime([0, 10, HOUR])})
    assert c.ingest_pandas(frame, time="at", price_scale=100) == 3
    assert c.ingest_arrow(pa.table({"sym": [2], "price": [7], "volume": [1], "at": [5]}), time="at") == 1
    assert c.query_pandas("SELECT symbol, sum(price) AS p FROM own GROUP BY symbol ORDER BY symbol").values.tolist() == [[1, 150], [2, 332]]
    assert c.query_numpy("SELECT timestamp FROM own ORDER BY timestamp")["timestamp"].tolist() == [0, 5, 10, HOUR]
    assert c.query("SELECT count(*) AS n FROM own").to_dict() == {"n": [4]} and list(c.execute("SELECT 1 AS a")) == [(1,)]
    with pytest.raises(Exception):
        c.query("SELECT nothing FROM nowhere")
    assert c.ping() and c.health()["status"] == "ok" and c.stats() == {"queries": 4, "rows": 4, "failed": 1}
    assert infer_schema(frame) == {"sym": "BIGINT", "price": "DOUBLE", "volume": "BIGINT", "at": "TIMESTAMP"}
    assert infer_schema(spark.createDataFrame([(1, "x")], "a int, b string")) == {"a": "INT", "b": "VARCHAR"}
    assert arrow_schema({"a": "INT64", "b": "odd", "c": "TIMESTAMP_NS", "d": "REAL"}) == pa.schema([("a", pa.int64()), ("b", pa.float64()), ("c", pa.timestamp("ns", "UTC")), ("d", pa.float32())])


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "ticks"), batch=4)
    e.ingest(1, 100, 2, 10)
    e.ingest_batch([1, 1, 2, 1], [1.1, 1.2, 9.0, 0.5], [1, 1, 1, 0], [20, 30, 40, HOUR], price_scale=100)
    assert e.stats() == {"stored": 4, "waiting": 1}
    assert e.count(1) == 4 and e.count(1, 0, 30) == 3 and e.stats() == {"stored": 5, "waiting": 0}
    assert e.vwap(1) == pytest.approx((200 + 110 + 120) / 4) and e.filter_sum(1, "price", 105) == 230
    assert e.column(1, "price").tolist() == [100, 110, 120, 50]


def test_retention(spark, tmp_path):
    hot, cold, shots = (str(tmp_path / x) for x in ("hot", "cold", "shots"))
    rows = spark.createDataFrame([(i % 3, i * HOUR // 4, i, 1, i) for i in range(40)], "symbol long, timestamp long, price long, volume long, seq long")
    store.write_ticks(rows, hot)
    keep = store.Retention(spark, hot, cold, seal_after_ns=2 * HOUR, ttl_ns=6 * HOUR, snapshots=shots)
    assert keep.recover() is None
    done = keep.run(10 * HOUR)
    read = lambda *paths: sorted(r.seq for p in paths for r in store.read_ticks(spark, p).collect())
    assert read(hot) == list(range(32, 40)) and read(hot, cold) == list(range(16, 40)) and done["sealed"] and done["expired"]
    assert sorted(r.seq for r in keep.recover().collect()) == list(range(32, 40))
    again = keep.run(10 * HOUR + 1)  # the hour that starts at the limit goes now
    assert again["sealed"] == 0 and read(hot, cold) == list(range(20, 40))
    assert store.key_path("s3a://{bucket}/{table}/{date}/{hour}", "t", 25 * HOUR, "b") == "s3a://b/t/1970-01-02/01"


def test_lexer():
    whole = lambda sql: lexer.text_of(lexer.whole_division(lexer.tokens(sql), {"d"}.__contains__))
    assert lexer.without_comments("a -- b 'c'\n, '--d' /* e' */ f").split() == ["a", ",", "'--d'", "f"]
    assert whole("x + a * b / c") == "x + (CASE WHEN ( c) = 0 THEN 0L ELSE (a * b ) div nullif(( c), 0) END)"
    for same in ("d / a", "a / 2.5", "avg(a) / b", "'a / b'", "a / 1e3"):
        assert whole(same) == same


def test_division_and_orders(spark):
    one = lambda x: dialect.sql(spark, f"SELECT {x} AS v FROM (SELECT 17 AS a, 5 AS b, 0 AS z, 2.5D AS r)").first()[0]
    assert [one(x) for x in ("a / b", "-a / b", "a / z", "a / b / 2", "100 - a / b * 2", "(a + 3) / (b - 1)", "a / nullif(b, 5)")] == [3, -3, 0, 1, 94, 5, None]
    left = spark.createDataFrame([(1, t) for t in (5, 10, 15)], "k long, t long")
    right = spark.createDataFrame([(1, 10, 1), (1, 10, 2), (1, 12, 3), (None, 5, 4)], "k long, t long, v long")
    at = lambda **how: [r.v for r in joins.asof_join(left, right.withColumnRenamed("t", "u"), ["k"], "t", "u", ["v"], ties="v", inner=False, **how).orderBy("t").collect()]
    assert at() == [None, 2, 3] and at(strict=True) == [None, None, 3]
    assert at(forward=True) == [1, 1, None] and at(forward=True, strict=True) == [1, 3, None]


def test_window_join_of_equal_rows(spark):
    left = spark.createDataFrame([(1, 10), (1, 10), (2, 10), (None, 10), (1, None)], "k long, t long")
    right = spark.createDataFrame([(1, 9, 3), (1, 10, 4), (1, 30, 9), (None, 10, 5)], "k long, u long, v long")
    got = joins.window_join(left, right, ["k"], "t", "u", "v", 1, 0)
    assert sorted(((r.k, r.t, r.wj_sum, r.wj_count) for r in got.collect()), key=str) == sorted([(1, 10, 7, 2), (1, 10, 7, 2), (2, 10, 0, 0), (None, 10, 0, 0), (1, None, 0, 0)], key=str)


def test_literals():
    assert foreign.literal("a\\b'c", "duckdb") == "'a\\b''c'" and foreign.literal("a\\b", "clickhouse") == "'a\\\\b'"
