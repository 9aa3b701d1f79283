"""Text for other databases (run in DuckDB where it is the target), the HTTP front, schedules, ingestion, snapshots, crypto messages."""

import json
import socket
import time
import urllib.error
import urllib.request
from datetime import datetime, timezone

import duckdb
import pytest

from tickspark import migrate, schedule, server
from tickspark.plans import foreign
from tickspark.sources import feeds, multicast, store
from tickspark.streaming.monitor import Progress
from tickspark.streaming.session import IngestSession


def test_tables_for_others():
    for name in ("trades", "quotes", "orderbook"):
        db = duckdb.connect()
        db.execute(foreign.create_table(name, foreign.market_schema(name), "duckdb"))
        assert [r[0] for r in db.execute(f"describe {name}").fetchall()] == foreign.market_schema(name).fieldNames()
    text = foreign.create_table("trades", foreign.market_schema("trades"), "clickhouse", ttl_days=9)
    assert "ORDER BY (`sym`, `timestamp`)" in text and "INTERVAL 9 DAY" in text and "`sym` LowCardinality(String)" in text
    assert len(foreign.hypertable("trades", retain_days=3)) == 4
    with pytest.raises(ValueError):
        foreign.create_table("t", foreign.market_schema("trades"), "oracle")


def test_queries_for_others():
    db = duckdb.connect()
    db.execute("create table t as select * from (values (timestamp '2024-01-01 00:01:00', 'a', 10, 1), (timestamp '2024-01-01 00:04:00', 'a', 20, 3), (timestamp '2024-01-01 00:06:00', 'a', 5, 2)) v(timestamp, sym, price, volume)")
    sql = "SELECT xbar(timestamp, 300000000000) AS bar, first(price) AS o, last(price) AS c, vwap(price, volume) AS v, 'first(x)' AS s FROM t GROUP BY xbar(timestamp, 300000000000) ORDER BY bar"
    got = db.execute(foreign.query_text(sql, "duckdb")).fetchall()
    assert [r[1:] for r in got] == [(10, 20, 17.5, "first(x)"), (5, 5, 5.0, "first(x)")]
    assert "toStartOfInterval(timestamp, INTERVAL 300 SECOND)" in foreign.query_text(sql, "clickhouse") and "argMin(price, timestamp)" in foreign.query_text(sql, "clickhouse")
    assert "first(price, timestamp)" in foreign.query_text(sql, "timescale")
    assert foreign.query_text("SELECT max(first(price)) FROM t", "duckdb") == "SELECT max(arg_min(price, timestamp)) FROM t"
    db.execute("create table q as select timestamp '2024-01-01 00:02:00' as timestamp, 'a' as sym, 7 as bid")
    assert len(db.execute(foreign.asof("t", "q", ["sym"], "timestamp", ["bid"], "duckdb")).fetchall()) == 2
    assert len(db.execute(foreign.asof("t", "q", ["sym"], "timestamp", ["bid"], "timescale")).fetchall()) == 2


def test_rows_for_others(tmp_path):
    db = duckdb.connect()
    db.execute("create table t (a bigint, b varchar)")
    db.execute(foreign.insert_values("t", ["a", "b"], [(1, "it's"), (None, None)], "duckdb"))
    assert db.execute("select * from t order by a").fetchall() == [(1, "it's"), (None, None)]
    db.execute(foreign.copy_parquet("select * from t where a = 1", str(tmp_path / "out"), ["a"]))
    db.execute(foreign.parquet_view("v", str(tmp_path / "out")))
    assert db.execute("select b, a from v").fetchall() == [("it's", 1)]


def test_migrate_prints(capsys):
    migrate.main(["q", "select max price by sym from trades"])
    migrate.main(["table", "trades", "--to", "timescale"])
    migrate.main(["query", "SELECT first(price) FROM t", "--to", "clickhouse"])
    out = capsys.readouterr().out
    assert "GROUP BY" in out and "create_hypertable" in out and "argMin(price, timestamp)" in out


def test_http_front(spark):
    front = server.Front(spark, tokens=("secret",), limit=5)
    http = server.serve(front)
    base = "http://{}:{}".format(*http.server_address)

    def ask(path="/", sql=None, token="secret", method=None):
        request = urllib.request.Request(base + path, sql.encode() if sql else None, {"Authorization": f"Bearer {token}"}, method=method)
        try:
            with urllib.request.urlopen(request, timeout=60) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert ask("/ping")[0] == 200
        status, body = ask(sql="SELECT id AS n FROM range(3) ORDER BY id")
        assert status == 200 and body["columns"] == ["n"] and body["data"] == [[0], [1], [2]] and body["rows"] == 3
        assert ask(sql="SELECT id FROM range(50)")[1]["rows"] == 5
        assert ask(sql="SELECT nothing FROM nowhere")[0] == 400
        assert ask(sql="SELECT 1", token="wrong")[0] == 401
        assert ask("/none", method="DELETE")[0] == 404
        assert ask("/stats")[1]["failed"] == 1
        front.timeout = 0.0
        assert ask(sql="SELECT count(*) FROM range(1000000000)")[0] == 408
    finally:
        http.shutdown()


def test_schedule():
    jobs, seen = schedule.Scheduler(), []
    one = jobs.every(0.01, lambda: seen.append(1))
    bad = jobs.every(0.01, lambda: 1 / 0)
    late = jobs.once(datetime.now(timezone.utc), lambda: seen.append(2))
    end = time.time() + 10
    while time.time() < end and (seen.count(1) < 3 or 2 not in seen or jobs.runs[bad] < 2):
        time.sleep(0.01)
    assert seen.count(1) >= 3 and seen.count(2) == 1 and isinstance(jobs.errors[bad], ZeroDivisionError)
    assert jobs.cancel(one) and not jobs.cancel(one)
    jobs.shutdown()
    assert jobs.active() == [] and not jobs.cancel(late)
    assert schedule.until(0, 0, datetime(2024, 1, 1, tzinfo=timezone.utc)) == 86400


def test_ingest_seal_snapshot(spark, tmp_path):
    path, heard = str(tmp_path / "ticks"), []
    good = spark.createDataFrame([(1, 10.5, 2.0, 5), (1, 11.0, None, 6)], "sym long, price double, volume double, ts long")
    s = IngestSession(path, on_error="skip", columns={"price_scale": 100.0, "time": "ts"}, progress=lambda b, n: heard.append((b, n)))
    s.add_all([good, spark.range(1), good])
    assert (s.rows, s.batches, s.failed) == (4, 2, 1) and heard == [(1, 2), (2, 4)]
    assert {tuple(r) for r in store.read_ticks(spark, path).select("price", "volume").collect()} == {(1050, 2), (1100, 0)}
    with pytest.raises(ValueError):
        IngestSession(path, on_error="maybe")

    hour = 3_600_000_000_000
    hot = spark.createDataFrame([(1, 5, 1, 1), (1, hour + 1, 2, 1), (1, 2 * hour, 3, 1)], "symbol long, timestamp long, price long, volume long")
    stays = store.seal(hot, str(tmp_path / "cold"), 2 * hour)
    both = store.hot_and_cold(stays, store.read_ticks(spark, str(tmp_path / "cold")))
    assert [r.price for r in stays.collect()] == [3] and sorted(r.price for r in both.collect()) == [1, 2, 3]

    store.snapshot(hot, str(tmp_path / "snap"))
    assert store.recover(spark, str(tmp_path / "snap")).count() == 3
    with pytest.raises(ValueError):
        store.recover(spark, path + "none")
    table = store.to_arrow(hot, end=hour + 1)
    assert table.num_rows == 2 and str(table.schema.field("timestamp").type) == "timestamp[ns, tz=UTC]"


def test_stream_progress(spark, tmp_path):
    spark.range(7).write.parquet(str(tmp_path / "in"))
    progress = Progress()
    spark.streams.addListener(progress)
    try:
        run = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.queryName("seven").format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        run.awaitTermination(60)
        end = time.time() + 20
        while time.time() < end and progress.rows.get("seven") != 7:
            time.sleep(0.05)
    finally:
        spark.streams.removeListener(progress)
    assert 'tickspark_rows_total{query="seven"} 7' in progress.text()


def test_crypto_messages(spark):
    trade = {"e": "trade", "s": "AB", "t": 9, "p": "1.2345", "q": "0.5", "T": 1700000000123, "m": True}
    best = {"u": 4, "s": "AB", "b": "1.1", "B": "2", "a": "1.3", "A": "3"}
    df = spark.createDataFrame([(json.dumps({"stream": "x", "data": trade}),), (json.dumps(best),), ("{",), (None,)], "value string")
    got = feeds.crypto_messages(df).collect()
    assert tuple(got[0]) == ("trade", "AB", 1700000000123000000, 12345, 0.5, "sell", 9, None, None, None, None)
    assert tuple(got[1]) == ("quote", "AB", None, None, None, None, 4, 11000, 2.0, 13000, 3.0)
    assert [r.kind for r in got[2:]] == ["other", "other"]


def test_datagrams(spark, tmp_path):
    spare = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    spare.bind(("127.0.0.1", 0))
    port = spare.getsockname()[1]
    spare.close()
    multicast.register(spark)
    stream = spark.readStream.format("udp").option("group", "127.0.0.1").option("port", port).option("most", 3).load()
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).start()
    sent, out = [f"{i}".encode() * 10 for i in range(8)], socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    try:
        until = time.time() + 60
        while time.time() < until and not query.recentProgress:
            time.sleep(0.1)
        for value in sent:
            out.sendto(value, ("127.0.0.1", port))
        got = []
        while time.time() < until and len(got) < len(sent):
            time.sleep(0.3)
            got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).orderBy("number").collect() if (tmp_path / "out").exists() else []
    finally:
        query.stop()
        out.close()
    assert [bytes(r.value) for r in got] == sent and [r.number for r in got] == list(range(8)) and all(r.received_ns > 0 for r in got)


def test_multicast_group():
    try:
        s = multicast.listen("239.1.2.3", 0, "127.0.0.1")
    except OSError as e:
        pytest.skip(f"no multicast here: {e}")
    out = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    out.setsockopt(socket.IPPROTO_IP, socket.IP_MULTICAST_IF, socket.inet_aton("127.0.0.1"))
    with s, out:
        out.sendto(b"one", ("239.1.2.3", s.getsockname()[1]))
        out.sendto(b"two", ("239.1.2.3", s.getsockname()[1]))
        assert [v for _, v in multicast.drain(s, 1, 5.0) + multicast.drain(s, 9, 0.5)] == [b"one", b"two"]
