"""q, EMA in SQL, binary feeds, splayed tables, and the command line."""

import json
import struct

import pytest

from tickspark import cli, server
from tickspark.plans import dialect, q
from tickspark.sources import binary, splayed


@pytest.fixture(scope="module")
def deals(spark):
    rows = [("A", 1, 1, 10, 5), ("A", 2, 2, 30, 5), ("A", 3, 3, 20, 10), ("B", 1, 4, 7, 1), ("B", 4, 5, None, 3)]
    df = spark.createDataFrame(rows, "sym string, timestamp long, seq long, price long, size long")
    df.createOrReplaceTempView("deals")
    return df


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_q_runs(spark, deals):
    assert rows(q.run(spark, "select open:first price, n:count i by sym from deals"), "sym") == [("A", 10, 3), ("B", 7, 2)]
    assert rows(q.run(spark, "select v:size wavg price from deals where sym=`A"), "v") == [(20.0,)]
    assert rows(q.run(spark, "select price by sym from deals where not null price"), "sym") == [("A", [10, 30, 20]), ("B", [7])]
    assert rows(q.run(spark, "select by sym from deals"), "sym") == [("A", 3, 3, 20, 10), ("B", 4, 5, None, 3)]
    assert rows(q.run(spark, "select seq from deals where price=(max;price) fby sym"), "seq") == [(2,), (4,)]
    assert rows(q.run(spark, "select seq from deals where size>5,price=(max;price) fby sym"), "seq") == [(3,)]
    assert rows(q.run(spark, "exec distinct sym from deals"), "sym") == [("A",), ("B",)]
    assert rows(q.run(spark, "select seq, m:2 mavg price by sym from deals where sym=`A"), "seq") == [("A", 1, 10.0), ("A", 2, 20.0), ("A", 3, 25.0)]
    assert rows(q.run(spark, "select seq, e:0.5 ema price by sym from deals where sym in `A`C"), "seq") == [("A", 1, 10), ("A", 2, 20), ("A", 3, 20)]


def test_window_join_of_two_columns(spark):
    spark.createDataFrame([("A", 100, 1), ("A", 200, 2), ("B", 100, 3)], "sym string, timestamp long, seq long").createOrReplaceTempView("hits")
    spark.createDataFrame([("A", 92, 10, 13), ("A", 97, 20, 27), ("A", 104, 40, 44), ("A", 190, 30, 31)], "sym string, timestamp long, bid long, ask long").createOrReplaceTempView("offers")
    join = "FROM hits t WINDOW JOIN offers q ON t.sym = q.sym AND q.timestamp BETWEEN t.timestamp - 10 AND t.timestamp"
    want = [(1, 40, 13, 40, 3), (2, 30, 31, 30, 1), (3, 0, 0, 0, 0)]
    text = f"SELECT t.seq, wj_max(q.bid) AS hi, wj_min(q.ask) AS lo, wj_max(bid) AS again, wj_count(q.ask) AS n {join}"
    assert rows(dialect.sql(spark, f"{text} + 10"), "seq") == want
    assert rows(q.run(spark, "wj[-10 10;`sym`timestamp;hits;(offers;(max;`bid);(min;`ask))]"), "seq") == [("A", 100, 1, 40, 13), ("A", 200, 2, 30, 31), ("B", 100, 3, 0, 0)]
    # an upper bound before the row, and what would be left out
    assert rows(dialect.sql(spark, f"SELECT t.seq, wj_sum(q.bid) AS s {join} - 5"), "seq") == [(1, 10), (2, 30), (3, 0)]
    for bad in (f"SELECT wj_max(q.bid) {join} * 2", f"SELECT wj_max(q.bid) {join} + 5 AND q.bid > 1", f"SELECT wj_max(q.bid) {join} - 20", f"SELECT wj_max(q.bid), wj_min(q.ask + 1) {join}", f"SELECT wj_max(q.bid), wj_max(t.seq) {join}", f"SELECT wj_dev(q.bid) {join}"):
        with pytest.raises(ValueError):
            dialect.sql(spark, bad)


def test_results_are_whole(spark, tmp_path, capsys):
    text = "SELECT id FROM range(0, 2500, 1, 3) ORDER BY id"
    whole = "\n".join(["id", *map(str, range(2500))])
    assert cli.respond(spark, text, "csv") == cli.respond(spark, text, "tsv") == whole
    assert json.loads(cli.respond(spark, text, "json")) == {"columns": ["id"], "data": [[i] for i in range(2500)], "rows": 2500}
    assert cli.respond(spark, text).endswith("(1000 rows, truncated)") and cli.respond(spark, text, limit=2500).endswith("(2500 rows)")
    assert json.loads(cli.respond(spark, text, "json", 2)) == {"columns": ["id"], "data": [[0], [1]], "rows": 2, "truncated": True}
    assert "truncated" not in cli.respond(spark, text, "json", 2500)
    cli.main([str(tmp_path), text, "-f", "csv"])
    assert capsys.readouterr().out == whole + "\n"
    cli.main([str(tmp_path), text, "-f", "csv", "-n", "2"])
    assert capsys.readouterr() == ("id\n0\n1\n", "truncated after 2 rows\n")
    status, body = server.Front(spark).query("SELECT id FROM range(0, 12000, 1, 3)")
    body.seek(0)
    got = json.load(body)
    assert status == 200 and got["rows"] == len(got["data"]) == 12_000 and got["execution_time_us"] > 0 and "truncated" not in got
    body = server.Front(spark, limit=5).query("SELECT id FROM range(50)")[1]
    body.seek(0)
    assert json.load(body)["truncated"] is True


def test_q_changes_no_table(spark, deals):
    out = q.run(spark, "update price:0, top:max price by sym from deals where size<10")
    assert out.columns == ["sym", "timestamp", "seq", "size", "price", "top"]
    assert [r[2:] for r in rows(out, "seq")] == [(1, 5, 0, 30), (2, 5, 0, 30), (3, 10, 20, None), (4, 1, 0, 7), (5, 3, 0, 7)]
    assert rows(q.run(spark, "delete from deals where price<15").select("seq"), "seq") == [(2,), (3,), (5,)]
    assert q.run(spark, "delete price from deals").columns == ["sym", "timestamp", "seq", "size"]
    assert deals.count() == 5


def test_q_reads_right_to_left():
    assert q.translate("select x:2*price+1 from t") == "SELECT (2 * (price + 1)) AS x FROM t"
    assert q.translate("select -5+price from t").startswith("SELECT (-5 + price)")
    assert q.translate("select price-5 from t").startswith("SELECT (price - 5)")
    assert q.translate("select $[p>1;`a;`b] from t / words").startswith("SELECT CASE WHEN (p > 1) THEN 'a' ELSE 'b' END")
    assert q.nanos("1970.01.02D00:00:01.5") == 86_401_500_000_000 and q.nanos("00:05") == 300_000_000_000
    assert q.translate("aj[`sym`time;a;b]") == "SELECT * FROM a ASOF JOIN b ON a.sym = b.sym AND a.time >= b.time"


@pytest.mark.parametrize("text", ["", "rows from t", "select sum by sym", "select a from", "select a from t where", "select (a from t", "select from t where within", "aj[`a`t;(select from t);u]", "select {x+y}[a] from t", "select {a+1;x} b from t", "select {x from t", "select asc a from t", "select \"open from t"])
def test_q_refuses(text):
    with pytest.raises(ValueError):
        q.translate(text)


def test_q_as_pyspark(spark, deals):
    from pyspark.sql import functions as F

    for text in ("select n:count i by sym from deals", "select total:sum size from deals where price>7", "exec distinct sym from deals", "update t:sum size by sym from deals"):
        made = eval(q.to_pyspark(text), {"spark": spark, "F": F, "dialect": dialect})
        assert sorted(map(str, made.collect())) == sorted(map(str, q.run(spark, text).collect()))


def test_q_functions_and_lists(spark, deals):
    whole = {r.seq: r for r in deals.where("price is not null").collect()}
    got = q.run(spark, "select seq, a:{x*y+1}[price;size], b:{[p]h:p*2;h-1} price, c:{x+1} each size, d:abs each price-20, e:til size mod 4 from deals where not null price").collect()
    for r in got:
        own = whole[r.seq]
        assert (r.a, r.b, r.c, r.d, r.e) == (own.price * (own["size"] + 1), 2 * own.price - 1, own["size"] + 1, abs(own.price - 20), list(range(own["size"] % 4)))
    by_time = {}
    for r in sorted(whole.values(), key=lambda r: (r.timestamp, r.seq)):
        by_time.setdefault(r.sym, []).append(r.price)
    got = q.run(spark, "select up:asc price, down:desc price, back:reverse price, flat:raze til 2 by sym from deals where not null price").collect()
    assert {r.sym: (r.up, r.down, r.back, len(r.flat)) for r in got} == {k: (sorted(v), sorted(v, reverse=True), v[::-1], 2 * len(v)) for k, v in by_time.items()}
    got = q.run(spark, "select n:count each p, top:max each p, total:sum each p from (select p:price by sym from deals where not null price)").collect()
    assert sorted(map(tuple, got)) == sorted((len(v), max(v), sum(v)) for v in by_time.values())
    run = {}
    for r in q.run(spark, "select seq, sym, p:prds price-15 from deals where not null price").collect():
        run[r.seq] = r.p
    product, want = 1, {}
    for r in sorted(whole.values(), key=lambda r: (r.timestamp, r.seq)):
        product *= r.price - 15
        want[r.seq] = product
    assert run == pytest.approx(want)


def test_ema_in_sql(spark):
    spark.createDataFrame([(1, t, v) for t, v in enumerate([10, 20, 30, 40, 50])], "k long, t long, v long").createOrReplaceTempView("golden")
    text = "SELECT *, ema(v, 0.5) OVER (PARTITION BY k ORDER BY t) AS e FROM golden ORDER BY t"
    out = dialect.sql(spark, text)
    assert out.columns == ["k", "t", "v", "e"] and [r.e for r in out.collect()] == [10, 15, 22, 31, 40]
    assert [r.ema for r in dialect.sql(spark, "SELECT t, ema(v * 10, 0.5) OVER (ORDER BY t) FROM golden WHERE t > 2 ORDER BY t").collect()] == [400, 450]
    with pytest.raises(ValueError):
        dialect.sql(spark, "SELECT k, ema(v, 0.5) FROM golden GROUP BY k")


def itch(kind, clock, *, side=b"B", stock=b"ACME    ", price=1_500_000, shares=300, order=77, at=123_456_789):
    body = struct.pack(">HH", 1, 2) + at.to_bytes(clock) + struct.pack(">Q", order)
    body += {b"A": side + struct.pack(">I", shares) + stock + struct.pack(">I", price), b"P": side + struct.pack(">I", shares) + stock + struct.pack(">IQ", price, 5), b"E": struct.pack(">IQ", shares, 5)}[kind]
    return struct.pack(">H", len(body) + 1) + kind + body


@pytest.mark.parametrize("clock", [6, 8])
def test_itch(spark, clock):
    values = [itch(b"A", clock), itch(b"P", clock, side=b"S", price=10_001), itch(b"E", clock), itch(b"A", clock)[:20], b"\0\1S", b"", None]
    out = [tuple(r) for r in binary.itch_ticks(spark.createDataFrame([(v,) for v in values], "value binary").coalesce(1)).collect()]
    assert out[:3] == [("order", "ACME", 123_456_789, 150.0, 300, "buy", "77"), ("trade", "ACME", 123_456_789, 1.0001, 300, "sell", "77"), ("trade", None, 123_456_789, None, 300, None, "77")]
    assert all(r == (None,) * 7 for r in out[3:])


def test_framed_files(spark, tmp_path):
    messages = [itch(b"A", 6), itch(b"E", 6), itch(b"P", 6)]
    (tmp_path / "day.itch").write_bytes(b"".join(messages) + b"\0\xffA")
    (tmp_path / "none.itch").write_bytes(b"")
    out = binary.framed_messages(spark, str(tmp_path)).orderBy("place")
    assert [bytes(r.value) for r in out.collect()] == messages
    assert binary.itch_ticks(out).where("kind = 'trade'").count() == 2


def test_tick_records(spark):
    record = struct.pack("<QqI4xqqB23x", 9, -5, 4_000_000_000, -7, 12, 2)
    out = binary.tick_records(spark.createDataFrame([(record,), (record[:63],), (None,)], "value binary").coalesce(1)).collect()
    assert tuple(out[0]) == (4_000_000_000, -5, -7, 12, 9, "ask")
    assert tuple(out[1]) == tuple(out[2]) == (None,) * 6


def test_splayed(spark, tmp_path):
    (tmp_path / "sym").write_bytes(b"AAPL\0MSFT\0")
    for date, n in (("2024.01.01", 3), ("2024.01.02", 2)):
        folder = tmp_path / date / "trades"
        folder.mkdir(parents=True)
        (folder / "sym").write_bytes(bytes([1, 11, 0, 0, 0, 0, 0, 0]) + struct.pack(f"<{n}i", *range(n)))
        (folder / "price").write_bytes(bytes([1, 9, 0, 0, 0, 0, 0, 0]) + struct.pack(f"<{n}d", *(1.5 * i for i in range(n))))
        (folder / "size").write_bytes(bytes([0, 7, 0, 0, 0, 0, 0, 0]) + struct.pack(f">{n}q", *range(n)))
        (folder / ".d").write_bytes(b"")
    (tmp_path / "2024.01.02" / "trades" / "size").unlink()
    out = splayed.read_splayed(spark, str(tmp_path), "trades")
    assert dict(out.dtypes) == {"date": "string", "row": "bigint", "price": "double", "size": "bigint", "sym": "string"}
    assert rows(out, "date", "row") == [("2024.01.01", 0, 0.0, 0, "AAPL"), ("2024.01.01", 1, 1.5, 1, "MSFT"), ("2024.01.01", 2, 3.0, 2, None), ("2024.01.02", 0, 0.0, None, "AAPL"), ("2024.01.02", 1, 1.5, None, "MSFT")]
    assert splayed.read_splayed(spark, str(tmp_path), "trades", dates="2024.01.02").count() == 2
    assert {(r.table, r.date) for r in splayed.tables(spark, str(tmp_path)).collect()} == {("trades", "2024.01.01"), ("trades", "2024.01.02")}
    with pytest.raises(ValueError):
        splayed.decode(b"\1\x63" + b"\0" * 6, [])


def test_command_line(spark, deals):
    text = "SELECT sym, price FROM deals WHERE sym = 'B' ORDER BY seq"
    assert cli.respond(spark, text, "csv") == "sym,price\nB,7\nB,"
    assert cli.respond(spark, text, "tsv").splitlines()[0] == "sym\tprice"
    assert json.loads(cli.respond(spark, text, "json")) == {"columns": ["sym", "price"], "data": [["B", 7], ["B", None]], "rows": 2}
    assert cli.respond(spark, text).splitlines() == ["sym | price", "----+------", "B   | 7", "B   | NULL", "(2 rows)"]
    assert cli.respond(spark, "\\t " + text).endswith(" ms")
    assert "Scan" in cli.respond(spark, "EXPLAIN " + text)
    answers = list(cli.converse(spark, ["\\f csv", "SELECT nothing FROM nowhere", "", "\\q exec distinct sym from deals where sym=`A"]))
    assert answers[0].startswith("error: ") and answers[1:] == ["sym\nA"]
