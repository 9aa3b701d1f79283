"""Queries of the library's own operators, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tickspark.functions import scalars as fn
from tickspark.operators import bars, joins, relational, windows
from tickspark.plans import dialect, q
from tickspark.session import scratch
from tickspark.sources import binary, feeds, store
from tickspark.sources.tables import quotes, table, ticks, trades
from tickspark.streaming import bars as stream

Query = Callable[[SparkSession, str], DataFrame]
BAR = 300_000_000_000
#: Time range of the point queries.
POINTS = (1_704_240_000_000_000_000, 1_705_968_000_000_000_000)
#: The driver's tables as ticks.
VIEWS = """WITH ticks AS (
  SELECT user_id AS symbol, epoch_us(ts) * 1000 AS timestamp, CAST(round(value * 100) AS BIGINT) AS price,
         event_id % 100 + 1 AS volume, event_id AS seq, event_type AS kind FROM events),
trades AS (SELECT symbol, timestamp, price, volume, seq FROM ticks WHERE kind = 'purchase'),
quotes AS (SELECT symbol, timestamp, price AS bid, price + 1 AS ask, seq FROM ticks WHERE kind IN ('view', 'click'))
"""
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def by_time() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("timestamp", "seq")


def last_ten() -> WindowSpec:
    return by_time().rowsBetween(-9, 0)


def register(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = VIEWS + sql


def in_dialect(name: str, text: str, sql: str) -> None:
    """A query whose text is the dialect's, over views of the tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for view, of in (("ticks", ticks), ("trades", trades), ("quotes", quotes), ("errors", lambda s, d: ticks(s, d).where("kind = 'error'"))):
            of(spark, sf_dir).createOrReplaceTempView(view)
        return dialect.sql(spark, text)

    register(name, run, sql)


def in_q(name: str, text: str, sql: str) -> None:
    """A query whose text is q, over views of the tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for view, of in (("ticks", ticks), ("trades", trades), ("quotes", quotes)):
            of(spark, sf_dir).createOrReplaceTempView(view)
        return q.run(spark, text)

    register(name, run, sql)


# --- scans, projection, predicates ---------------------------------------------------------------
register("scan_filter_project", lambda s, d: trades(s, d).where("price > 5000 and volume between 10 and 60").select("symbol", "timestamp", "price", "seq"), "SELECT symbol, timestamp, price, seq FROM trades WHERE price > 5000 AND volume BETWEEN 10 AND 60")
register("select_all", lambda s, d: trades(s, d), "SELECT * FROM trades")
register("arithmetic", lambda s, d: trades(s, d).select("seq", (F.col("price") * F.col("volume") - 7).alias("turnover"), fn.div("price", F.col("volume") % 5).alias("ratio")), "SELECT seq, price * volume - 7 AS turnover, CASE WHEN volume % 5 = 0 THEN 0 ELSE price // (volume % 5) END AS ratio FROM trades")
register("case_when", lambda s, d: ticks(s, d).select("seq", F.when(F.col("price") > 7500, 2).when(F.col("price") > 2500, 1).otherwise(0).alias("level")), "SELECT seq, CASE WHEN price > 7500 THEN 2 WHEN price > 2500 THEN 1 ELSE 0 END AS level FROM ticks")
register("distinct_rows", lambda s, d: ticks(s, d).select("symbol", "kind").distinct(), "SELECT DISTINCT symbol, kind FROM ticks")
register("in_like_null", lambda s, d: ticks(s, d).withColumn("n", F.expr("nullif(seq % 7, 0)")).where(F.col("n").isNull() | (F.col("volume").isin(1, 5, 9) & ~fn.like_int("price", "%5_"))).select("seq", "n"), "SELECT seq, nullif(seq % 7, 0) AS n FROM ticks WHERE seq % 7 = 0 OR (volume IN (1, 5, 9) AND NOT CAST(price AS VARCHAR) LIKE '%5_')")
register("parquet_pruned_scan", lambda s, d: table(s, d, "lineitem").where("l_quantity >= 45 and l_returnflag = 'R'").select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'")
# --- functions -------------------------------------------------------------------------------------
register("date_trunc_units", lambda s, d: ticks(s, d).select("seq", *(fn.date_trunc_ns(u, "timestamp").alias(u) for u in ("ms", "s", "min", "hour", "day", "week"))), "SELECT seq, " + ", ".join(f"timestamp // {fn.UNIT_NS[u]} * {fn.UNIT_NS[u]} AS {u}" for u in ("ms", "s", "min", "hour", "day", "week")) + " FROM ticks")
register("epoch_functions", lambda s, d: ticks(s, d).select("seq", fn.epoch_s("timestamp").alias("s"), fn.epoch_ms("timestamp").alias("ms"), fn.substr_int("price", 2, 2).alias("part")), "SELECT seq, timestamp // 1000000000 AS s, timestamp // 1000000 AS ms, coalesce(TRY_CAST(substring(CAST(price AS VARCHAR), 2, 2) AS BIGINT), 0) AS part FROM ticks")
register("xbar_scalar", lambda s, d: ticks(s, d).select("seq", fn.xbar(F.col("price") - 5000, 700).alias("bucket")), "SELECT seq, CAST(trunc((price - 5000) / 700.0) AS BIGINT) * 700 AS bucket FROM ticks")
register("math_functions", lambda s, d: trades(s, d).select("seq", F.abs(F.col("price") - 5000).alias("a"), F.floor(F.sqrt("price")).alias("r"), F.ceil(F.col("price") / 7).alias("c")), "SELECT seq, abs(price - 5000) AS a, CAST(floor(sqrt(price)) AS BIGINT) AS r, CAST(ceil(price / 7.0) AS BIGINT) AS c FROM trades")
# --- aggregation -----------------------------------------------------------------------------------
register("scalar_aggregates", lambda s, d: trades(s, d).agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("symbols"), F.coalesce(F.sum("volume"), F.lit(0)).alias("volume"), F.avg("price").cast("long").alias("mean"), F.min("price").alias("low"), F.max("price").alias("high")), "SELECT count(*) AS n, count(DISTINCT symbol) AS symbols, CAST(coalesce(sum(volume), 0) AS BIGINT) AS volume, CAST(trunc(avg(price)) AS BIGINT) AS mean, min(price) AS low, max(price) AS high FROM trades")
register("group_by_symbol", lambda s, d: ticks(s, d).groupBy("symbol").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"), F.countDistinct("kind").alias("kinds")), "SELECT symbol, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume, count(DISTINCT kind) AS kinds FROM ticks GROUP BY symbol")
register("group_by_two_having", lambda s, d: ticks(s, d).groupBy("symbol", "kind").agg(F.count("*").alias("n"), F.max("price").alias("high")).where("n > 5"), "SELECT symbol, kind, count(*) AS n, max(price) AS high FROM ticks GROUP BY symbol, kind HAVING count(*) > 5")
register("aggregate_of_expression", lambda s, d: trades(s, d).groupBy("symbol").agg(F.sum(F.col("price") * F.col("volume")).alias("turnover"), F.min(F.col("price") - 5000).alias("low")), "SELECT symbol, CAST(sum(price * volume) AS BIGINT) AS turnover, min(price - 5000) AS low FROM trades GROUP BY symbol")
register("first_last", lambda s, d: ticks(s, d).groupBy("symbol").agg(fn.first_by("price", "timestamp", "seq").alias("first"), fn.last_by("price", "timestamp", "seq").alias("last")), "SELECT symbol, arg_min(price, (timestamp, seq)) AS first, arg_max(price, (timestamp, seq)) AS last FROM ticks GROUP BY symbol")
register("vwap_by_symbol", lambda s, d: trades(s, d).groupBy("symbol").agg(fn.vwap("price", "volume").cast("long").alias("vwap")), "SELECT symbol, CAST(trunc(CAST(sum(price * volume) AS DOUBLE) / sum(volume)) AS BIGINT) AS vwap FROM trades GROUP BY symbol")
register("ohlcv_bars", lambda s, d: bars.ohlcv(trades(s, d), BAR).withColumn("vwap", F.col("vwap").cast("long")), f"SELECT symbol, timestamp // {BAR} * {BAR} AS bar, arg_min(price, (timestamp, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (timestamp, seq)) AS close, CAST(sum(volume) AS BIGINT) AS volume, CAST(trunc(CAST(sum(price * volume) AS DOUBLE) / sum(volume)) AS BIGINT) AS vwap FROM trades GROUP BY symbol, bar")
register("xbar_group_by", lambda s, d: ticks(s, d).groupBy(fn.xbar("timestamp", fn.UNIT_NS["hour"]).alias("hour")).agg(F.count("*").alias("n"), F.sum("volume").alias("volume")), "SELECT timestamp // 3600000000000 * 3600000000000 AS hour, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume FROM ticks GROUP BY hour")
register("median_spread", lambda s, d: ticks(s, d).groupBy("symbol").agg(F.median("price").alias("median"), F.round(F.var_samp("price"), 3).alias("variance"), F.round(F.stddev_pop("price"), 5).alias("deviation")), "SELECT symbol, median(price) AS median, round(var_samp(price), 3) AS variance, round(stddev_pop(price), 5) AS deviation FROM ticks GROUP BY symbol")
register("cube_kinds", lambda s, d: ticks(s, d).cube("symbol", "kind").agg(F.sum("volume").alias("volume")), "SELECT symbol, kind, CAST(sum(volume) AS BIGINT) AS volume FROM ticks GROUP BY CUBE (symbol, kind)")
register("point_vwap", lambda s, d: relational.point_vwap(trades(s, d, *POINTS), 3, *POINTS), "SELECT CASE WHEN count(*) > 0 THEN CAST(sum(price * volume) AS DOUBLE) / sum(volume) END AS vwap, count(*) AS n FROM trades WHERE symbol = 3 AND timestamp BETWEEN 1704240000000000000 AND 1705968000000000000")
register("point_filter_sum", lambda s, d: relational.point_filter_sum(ticks(s, d), 3, "price", 4000, 0, 2**62), "SELECT CAST(coalesce(sum(price), 0) AS BIGINT) AS total FROM ticks WHERE symbol = 3 AND price > 4000")
register("point_count", lambda s, d: relational.point_count(ticks(s, d, *POINTS), 3, *POINTS), "SELECT count(*) AS n FROM ticks WHERE symbol = 3 AND timestamp BETWEEN 1704240000000000000 AND 1705968000000000000")
# --- joins -----------------------------------------------------------------------------------------
for how in ("inner", "left", "right", "full"):
    register(
        f"join_{how}",
        lambda s, d, how=how: trades(s, d).groupBy("symbol").agg(F.sum("volume").alias("volume")).where("symbol % 3 <> 0").join(quotes(s, d).groupBy("symbol").agg(F.max("bid").alias("bid")).where("symbol % 2 = 0"), "symbol", how),
        f"SELECT coalesce(a.symbol, b.symbol) AS symbol, volume, bid FROM (SELECT symbol, CAST(sum(volume) AS BIGINT) AS volume FROM trades WHERE symbol % 3 <> 0 GROUP BY symbol) a {how} JOIN (SELECT symbol, max(bid) AS bid FROM quotes WHERE symbol % 2 = 0 GROUP BY symbol) b ON a.symbol = b.symbol",
    )
register("join_star", lambda s, d: table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")), "SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, o_orderpriority")
register("semi_anti", lambda s, d: table(s, d, "customer").join(table(s, d, "orders").where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").join(table(s, d, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
register("asof_join", lambda s, d: joins.asof_join(trades(s, d), quotes(s, d), ["symbol"], "timestamp", "timestamp", ["bid", "ask"], ties="seq"), "SELECT t.*, q.bid, q.ask FROM trades t ASOF JOIN quotes q ON t.symbol = q.symbol AND t.timestamp >= q.timestamp")
register("asof_join_left_only", lambda s, d: joins.asof_join(trades(s, d), quotes(s, d), ["symbol"], "timestamp", "timestamp", ["bid"], ties="seq", right_columns=False), "SELECT t.* FROM trades t ASOF JOIN quotes q ON t.symbol = q.symbol AND t.timestamp >= q.timestamp")
WJ = 6 * 3_600_000_000_000
register("window_join", lambda s, d: joins.window_join(trades(s, d), quotes(s, d), ["symbol"], "timestamp", "timestamp", "bid", WJ, WJ // 2, ["seq"]), f"SELECT t.symbol, t.timestamp, t.price, t.volume, t.seq, CAST(coalesce(trunc(avg(q.bid)), 0) AS BIGINT) AS wj_avg, CAST(coalesce(sum(q.bid), 0) AS BIGINT) AS wj_sum, count(q.bid) AS wj_count, coalesce(min(q.bid), 0) AS wj_min, coalesce(max(q.bid), 0) AS wj_max FROM trades t LEFT JOIN quotes q ON t.symbol = q.symbol AND q.timestamp BETWEEN t.timestamp - {WJ} AND t.timestamp + {WJ // 2} GROUP BY ALL")
register("union_join", lambda s, d: joins.union_join(trades(s, d), quotes(s, d)), "SELECT * FROM trades UNION ALL BY NAME SELECT * FROM quotes")
register("plus_join", lambda s, d: joins.plus_join(trades(s, d), ticks(s, d).where("kind = 'error'").select("symbol", "price", "seq"), ["symbol"], "seq"), "SELECT t.symbol, timestamp, t.price + coalesce(a.price, 0) AS price, volume, seq FROM trades t LEFT JOIN (SELECT symbol, arg_max(price, seq) AS price FROM ticks WHERE kind = 'error' GROUP BY symbol) a ON t.symbol = a.symbol")
# --- windows ---------------------------------------------------------------------------------------
register("ranks", lambda s, d: ticks(s, d).select("seq", F.row_number().over(by_time()).alias("row"), F.rank().over(Window.partitionBy("symbol").orderBy("volume")).alias("rank"), F.dense_rank().over(Window.partitionBy("symbol").orderBy("volume")).alias("dense")), "SELECT seq, row_number() OVER (PARTITION BY symbol ORDER BY timestamp, seq) AS row, rank() OVER (PARTITION BY symbol ORDER BY volume) AS rank, dense_rank() OVER (PARTITION BY symbol ORDER BY volume) AS dense FROM ticks")
register("rolling_frames", lambda s, d: ticks(s, d).select("seq", F.sum("volume").over(last_ten()).alias("s"), F.floor(F.sum("price").over(last_ten()) / F.count("*").over(last_ten())).alias("m"), F.min("price").over(by_time().rowsBetween(-3, 3)).alias("lo"), F.max("price").over(by_time().rowsBetween(Window.unboundedPreceding, 0)).alias("hi")), "SELECT seq, CAST(sum(volume) OVER w AS BIGINT) AS s, CAST(floor(CAST(sum(price) OVER w AS DOUBLE) / count(*) OVER w) AS BIGINT) AS m, min(price) OVER (PARTITION BY symbol ORDER BY timestamp, seq ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS lo, max(price) OVER (PARTITION BY symbol ORDER BY timestamp, seq ROWS UNBOUNDED PRECEDING) AS hi FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY timestamp, seq ROWS 9 PRECEDING)")
register("range_frame", lambda s, d: ticks(s, d).select("seq", F.count("*").over(Window.partitionBy("symbol").orderBy("timestamp").rangeBetween(-86_400_000_000_000, 0)).alias("day")), "SELECT seq, count(*) OVER (PARTITION BY symbol ORDER BY timestamp RANGE BETWEEN 86400000000000 PRECEDING AND CURRENT ROW) AS day FROM ticks")
register("lag_lead", lambda s, d: ticks(s, d).select("seq", F.lag("price", 2, 0).over(by_time()).alias("before"), F.lead("price", 1, 0).over(by_time()).alias("after")), "SELECT seq, lag(price, 2, 0) OVER w AS before, lead(price, 1, 0) OVER w AS after FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY timestamp, seq)")
register("delta_ratio", lambda s, d: ticks(s, d).select("seq", windows.delta("price", by_time()).alias("delta"), windows.ratio("price", by_time()).alias("ratio")), "SELECT seq, price - lag(price, 1, 0) OVER w AS delta, CASE WHEN row_number() OVER w = 1 THEN 1000000 WHEN lag(price) OVER w = 0 THEN 0 ELSE CAST(trunc(CAST(price AS DOUBLE) / nullif(lag(price) OVER w, 0) * 1000000) AS BIGINT) END AS ratio FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY timestamp, seq)")
register("ema", lambda s, d: windows.ema(ticks(s, d).select("symbol", "timestamp", "seq", "price"), "price", 0.5, ["symbol"], ["timestamp", "seq"]).select("seq", "ema"), ", RECURSIVE_R AS (SELECT symbol, seq, price, row_number() OVER (PARTITION BY symbol ORDER BY timestamp, seq) AS n FROM ticks), lists AS (SELECT symbol, list(CAST(price AS DOUBLE) ORDER BY n) AS p, list(seq ORDER BY n) AS s FROM RECURSIVE_R GROUP BY symbol) SELECT unnest(s) AS seq, unnest([CAST(trunc(list_reduce(p[greatest(1, i - 60):i], lambda a, x: 0.5 * x + 0.5 * a)) AS BIGINT) FOR i IN range(1, len(p) + 1)]) AS ema FROM lists")
register("running_vwap", lambda s, d: trades(s, d).select("seq", (F.sum(F.col("price") * F.col("volume")).over(last_ten()) / F.sum("volume").over(last_ten())).cast("long").alias("vwap")), "SELECT seq, CAST(trunc(CAST(sum(price * volume) OVER w AS DOUBLE) / sum(volume) OVER w) AS BIGINT) AS vwap FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY timestamp, seq ROWS 9 PRECEDING)")
register("ntile_cume", lambda s, d: ticks(s, d).select("seq", F.ntile(4).over(by_time()).alias("quarter"), F.round(F.cume_dist().over(Window.partitionBy("symbol").orderBy("volume")), 9).alias("share")), "SELECT seq, ntile(4) OVER (PARTITION BY symbol ORDER BY timestamp, seq) AS quarter, round(cume_dist() OVER (PARTITION BY symbol ORDER BY volume), 9) AS share FROM ticks")
# --- order, sets, subqueries -----------------------------------------------------------------------
register("top_k", lambda s, d: ticks(s, d).orderBy(F.desc("price"), "seq").limit(25).select("seq", "price"), "SELECT seq, price FROM ticks ORDER BY price DESC, seq LIMIT 25")
register("union_all", lambda s, d: trades(s, d).select("symbol").unionAll(quotes(s, d).select("symbol")), "SELECT symbol FROM trades UNION ALL SELECT symbol FROM quotes")
register("union_distinct", lambda s, d: trades(s, d).select("symbol", "volume").union(ticks(s, d).select("symbol", "volume")).distinct(), "SELECT symbol, volume FROM trades UNION SELECT symbol, volume FROM ticks")
register("intersect_keeping", lambda s, d: relational.intersect_keeping(trades(s, d).select("symbol", "volume"), ticks(s, d).where("kind = 'click'").select("symbol", "volume")), "SELECT symbol, volume FROM trades WHERE (symbol, volume) IN (SELECT symbol, volume FROM ticks WHERE kind = 'click')")
register("except_keeping", lambda s, d: relational.except_keeping(trades(s, d).select("symbol", "volume"), ticks(s, d).where("kind = 'click'").select("symbol", "volume")), "SELECT symbol, volume FROM trades WHERE (symbol, volume) NOT IN (SELECT symbol, volume FROM ticks WHERE kind = 'click')")
register("intersect_distinct", lambda s, d: trades(s, d).select("symbol").intersect(quotes(s, d).select("symbol")), "SELECT symbol FROM trades INTERSECT SELECT symbol FROM quotes")
register("except_distinct", lambda s, d: ticks(s, d).select("volume").subtract(trades(s, d).select("volume")), "SELECT volume FROM ticks EXCEPT SELECT volume FROM trades")
# --- the dialect -----------------------------------------------------------------------------------
in_dialect("sql_bars", f"SELECT symbol, xbar(timestamp, {BAR}) AS bar, first(price) AS open, last(price) AS close, sum(volume) AS volume, cast(vwap(price, volume) AS bigint) AS vwap FROM trades GROUP BY symbol, xbar(timestamp, {BAR})", f"SELECT symbol, timestamp // {BAR} * {BAR} AS bar, arg_min(price, (timestamp, seq)) AS open, arg_max(price, (timestamp, seq)) AS close, CAST(sum(volume) AS BIGINT) AS volume, CAST(trunc(CAST(sum(price * volume) AS DOUBLE) / sum(volume)) AS BIGINT) AS vwap FROM trades GROUP BY symbol, bar")
in_dialect("sql_asof", "SELECT t.symbol, t.timestamp, t.price - q.bid AS gap, q.ask FROM trades t ASOF JOIN quotes q ON t.symbol = q.symbol AND t.timestamp >= q.timestamp WHERE t.price > 1000", "SELECT t.symbol, t.timestamp, t.price - q.bid AS gap, q.ask FROM trades t ASOF JOIN quotes q ON t.symbol = q.symbol AND t.timestamp >= q.timestamp WHERE t.price > 1000")
in_dialect("sql_aj0", "SELECT * FROM trades t AJ0 JOIN quotes q ON t.symbol = q.symbol AND t.timestamp >= q.timestamp", "SELECT t.* FROM trades t ASOF JOIN quotes q ON t.symbol = q.symbol AND t.timestamp >= q.timestamp")
in_dialect("sql_window_join", f"SELECT t.seq, wj_avg(q.bid) AS mean, wj_count(q.bid) AS n FROM trades t WINDOW JOIN quotes q ON t.symbol = q.symbol AND q.timestamp BETWEEN t.timestamp - {WJ} AND t.timestamp + {WJ}", f"SELECT t.seq, CAST(coalesce(trunc(avg(q.bid)), 0) AS BIGINT) AS mean, count(q.bid) AS n FROM trades t LEFT JOIN quotes q ON t.symbol = q.symbol AND q.timestamp BETWEEN t.timestamp - {WJ} AND t.timestamp + {WJ} GROUP BY t.seq")
in_dialect("sql_union_join", "SELECT * FROM trades UNION JOIN quotes", "SELECT * FROM trades UNION ALL BY NAME SELECT * FROM quotes")
in_dialect("sql_windows", "SELECT seq, delta(price) OVER (PARTITION BY symbol ORDER BY timestamp, seq) AS change, ratio(price) OVER (PARTITION BY symbol ORDER BY timestamp, seq) AS ratio, avg(volume) OVER (PARTITION BY symbol ORDER BY timestamp, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) > 50 AS busy FROM ticks", "SELECT seq, price - lag(price, 1, 0) OVER w AS change, CASE WHEN row_number() OVER w = 1 THEN 1000000 WHEN lag(price) OVER w = 0 THEN 0 ELSE CAST(trunc(CAST(price AS DOUBLE) / nullif(lag(price) OVER w, 0) * 1000000) AS BIGINT) END AS ratio, avg(volume) OVER (PARTITION BY symbol ORDER BY timestamp, seq ROWS 4 PRECEDING) > 50 AS busy FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY timestamp, seq)")
in_dialect("sql_cte_subquery", "WITH b AS (SELECT symbol, date_trunc('hour', timestamp) AS h, sum(volume) AS v FROM ticks GROUP BY symbol, date_trunc('hour', timestamp)) SELECT h, max(v) AS top, sum(CASE WHEN v > 100 THEN 1 ELSE 0 END) AS large FROM (SELECT * FROM b WHERE v > 10) x GROUP BY h HAVING max(v) > 20 ORDER BY h", ", b AS (SELECT symbol, timestamp // 3600000000000 * 3600000000000 AS h, sum(volume) AS v FROM ticks GROUP BY ALL) SELECT h, CAST(max(v) AS BIGINT) AS top, CAST(sum(CASE WHEN v > 100 THEN 1 ELSE 0 END) AS BIGINT) AS large FROM b WHERE v > 10 GROUP BY h HAVING max(v) > 20")
in_dialect("sql_scalars", "SELECT seq, epoch_s(timestamp) AS s, epoch_ms(timestamp) AS ms, substr(price, 1, 2) AS lead2 FROM ticks WHERE now() > timestamp", "SELECT seq, timestamp // 1000000000 AS s, timestamp // 1000000 AS ms, coalesce(TRY_CAST(substring(CAST(price AS VARCHAR), 1, 2) AS BIGINT), 0) AS lead2 FROM ticks")
in_dialect("sql_ema", "SELECT seq, ema(price, 0.5) OVER (PARTITION BY symbol ORDER BY timestamp, seq) AS ema FROM ticks", ORACLE_SQL["ema"].removeprefix(VIEWS))
in_dialect("sql_window_join_two", f"SELECT t.seq, wj_max(q.bid) AS high, wj_min(q.ask) AS low, wj_sum(q.ask) AS total FROM trades t WINDOW JOIN quotes q ON t.symbol = q.symbol AND q.timestamp BETWEEN t.timestamp - {WJ} AND t.timestamp + 0", f"SELECT t.seq, coalesce(max(q.bid), 0) AS high, coalesce(min(q.ask), 0) AS low, CAST(coalesce(sum(q.ask), 0) AS BIGINT) AS total FROM trades t LEFT JOIN quotes q ON t.symbol = q.symbol AND q.timestamp BETWEEN t.timestamp - {WJ} AND t.timestamp GROUP BY t.seq")
in_dialect("sql_asof_forward", "SELECT t.seq, q.bid, q.seq AS quote FROM trades t ASOF JOIN quotes q ON t.symbol = q.symbol AND t.timestamp <= q.timestamp", "SELECT t.seq, q.bid, q.seq AS quote FROM trades t ASOF JOIN quotes q ON t.symbol = q.symbol AND t.timestamp <= q.timestamp")
in_dialect("sql_asof_strict", "SELECT t.seq, q.price FROM trades t ASOF JOIN ticks q ON t.symbol = q.symbol AND t.timestamp > q.timestamp", "SELECT t.seq, q.price FROM trades t ASOF JOIN ticks q ON t.symbol = q.symbol AND t.timestamp > q.timestamp")
in_dialect("sql_asof_cte", "WITH big AS (SELECT * FROM trades WHERE volume > 40) /* FROM x ASOF JOIN y */ SELECT x.symbol, x.seq, q.bid -- xbar( is no call here\nFROM big x ASOF JOIN (SELECT symbol, timestamp, bid, seq FROM quotes WHERE bid > 2000) q ON x.symbol = q.symbol AND x.timestamp >= q.timestamp ORDER BY x.seq", "SELECT x.symbol, x.seq, q.bid FROM trades x ASOF JOIN (SELECT * FROM quotes WHERE bid > 2000) q ON x.symbol = q.symbol AND x.timestamp >= q.timestamp WHERE x.volume > 40")
in_dialect("sql_asof_twice", "SELECT t.seq, q.bid, e.price AS error FROM trades t ASOF JOIN quotes q ON t.symbol = q.symbol AND t.timestamp >= q.timestamp ASOF JOIN errors e ON t.symbol = e.symbol AND t.timestamp >= e.timestamp", "SELECT t.seq, q.bid, e.price AS error FROM trades t ASOF JOIN quotes q ON t.symbol = q.symbol AND t.timestamp >= q.timestamp ASOF JOIN (SELECT * FROM ticks WHERE kind = 'error') e ON t.symbol = e.symbol AND t.timestamp >= e.timestamp")
in_dialect("sql_asof_subquery", "SELECT symbol, count(*) AS n, max(gap) AS widest FROM (SELECT t.symbol, t.price - q.bid AS gap FROM trades t ASOF JOIN quotes q ON t.symbol = q.symbol AND t.timestamp >= q.timestamp) g GROUP BY symbol", "SELECT t.symbol, count(*) AS n, max(t.price - q.bid) AS widest FROM trades t ASOF JOIN quotes q ON t.symbol = q.symbol AND t.timestamp >= q.timestamp GROUP BY t.symbol")
in_dialect("sql_division", "SELECT seq, price / (volume % 5) AS a, 2 * price / 7 * 3 AS b, (price - 9000) / volume AS c, price / 2e0 AS d, 100 - price / 10 / 3 AS e FROM trades", "SELECT seq, CASE WHEN volume % 5 = 0 THEN 0 ELSE price // (volume % 5) END AS a, 2 * price // 7 * 3 AS b, CAST(trunc(CAST(price - 9000 AS DOUBLE) / volume) AS BIGINT) AS c, CAST(price AS DOUBLE) / 2 AS d, 100 - price // 10 // 3 AS e FROM trades")
# --- messages, each made from ticks and read again ------------------------------------------------------
register("feed_json", lambda s, d: feeds.json_ticks(trades(s, d).select(F.to_json(F.struct(F.col("symbol").alias("symbol_id"), "price", "volume", F.col("timestamp").alias("ts"))).alias("value"))).where("reason is null").drop("reason"), "SELECT symbol, timestamp, price, volume FROM trades")
register("feed_fix", lambda s, d: feeds.fix_messages(trades(s, d).select(F.expr(r"concat_ws('\u0001', '8=FIX.4.4', '35=8', concat('55=S', symbol), concat('34=', seq), concat('31=', price / 100), concat('32=', volume), if(seq % 2 = 0, '54=1', '54=2'), '10=000', '')").alias("value"))).select("kind", "symbol", "price", "volume", "side", "sequence"), "SELECT 'tick' AS kind, 'S' || symbol AS symbol, CAST(price AS DOUBLE) / 100 AS price, volume, CASE WHEN seq % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, seq AS sequence FROM trades")


def _little(name: str, size: int = 8) -> str:
    digits = f"lpad(hex({name}), 16, '0')"
    return ", ".join(f"substring({digits}, {17 - 2 * i}, 2)" for i in range(1, size + 1))


register("feed_tick_record", lambda s, d: binary.tick_records(trades(s, d).select(F.expr(f"unhex(concat({_little('seq')}, {_little('timestamp')}, {_little('symbol', 4)}, '00000000', {_little('price')}, {_little('volume')}, repeat('00', 24)))").alias("value"))), "SELECT symbol, timestamp, price, volume, seq, 'trade' AS kind FROM trades")


# --- tick storage ----------------------------------------------------------------------------------------
def stored_ticks(s: SparkSession, d: str) -> DataFrame:
    """Ticks of which the hours before a time are sealed into storage, and the others still hot; one symbol's range is read over both."""
    path = scratch(s, "ticks")
    hot = store.seal(ticks(s, d), path, 1_705_000_000_000_000_000)
    cold = store.read_ticks(s, path, 3, *POINTS)
    return store.hot_and_cold(hot.where((F.col("symbol") == 3) & F.col("timestamp").between(*POINTS)), cold).select("seq", "timestamp", "price", "kind")


def streamed_bars(s: SparkSession, d: str) -> DataFrame:
    """Bars over ticks that arrive in files, a batch a file: each batch adds its sums to the state and replaces the bars that it touched."""
    path = scratch(s, "stream")
    trades(s, d).repartition(3).write.parquet(f"{path}/in")
    bars_of = stream.running_bars(s.readStream.schema(trades(s, d).schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), 24 * fn.UNIT_NS["hour"])
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
    bars_of.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = s.read.parquet(f"{path}/out").groupBy("symbol", "bar").agg(F.max_by(F.struct("open", "high", "low", "close", "volume"), "batch").alias("b"))
    return found.select("symbol", "bar", "b.*")


register("tick_storage", stored_ticks, f"SELECT seq, timestamp, price, kind FROM ticks WHERE symbol = 3 AND timestamp BETWEEN {POINTS[0]} AND {POINTS[1]}")
register("stream_bars", streamed_bars, "SELECT symbol, timestamp // 86400000000000 * 86400000000000 AS bar, arg_min(price, (timestamp, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (timestamp, seq)) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM trades GROUP BY symbol, bar")
# --- what the tables alone don't show: nulls, many-to-many keys, other aggregates ---------------------
NULLS = "SELECT *, nullif(seq % 7, 0) AS k FROM ticks"


def with_nulls(s: SparkSession, d: str) -> DataFrame:
    return ticks(s, d).withColumn("k", F.expr("nullif(seq % 7, 0)"))


register("count_with_nulls", lambda s, d: with_nulls(s, d).groupBy("symbol").agg(F.count("k").alias("n"), F.count("*").alias("rows"), F.sum("k").alias("total")), f"SELECT symbol, count(k) AS n, count(*) AS rows, CAST(sum(k) AS BIGINT) AS total FROM ({NULLS}) GROUP BY symbol")
register("nulls_first_last", lambda s, d: with_nulls(s, d).select("seq", F.row_number().over(Window.orderBy(F.asc_nulls_last("k"), "seq")).alias("last"), F.row_number().over(Window.orderBy(F.desc_nulls_first("k"), "seq")).alias("first")).where("seq % 50 = 7"), f"SELECT seq, last, first FROM (SELECT seq, row_number() OVER (ORDER BY k ASC NULLS LAST, seq) AS last, row_number() OVER (ORDER BY k DESC NULLS FIRST, seq) AS first FROM ({NULLS})) WHERE seq % 50 = 7")
register("percent_rank_nth", lambda s, d: ticks(s, d).select("seq", F.round(F.percent_rank().over(Window.partitionBy("symbol").orderBy("volume")), 9).alias("share"), F.nth_value("price", 3).over(by_time()).alias("third"), F.first("price").over(last_ten()).alias("oldest"), F.last("price").over(by_time().rowsBetween(0, 2)).alias("ahead")), "SELECT seq, round(percent_rank() OVER (PARTITION BY symbol ORDER BY volume), 9) AS share, nth_value(price, 3) OVER (PARTITION BY symbol ORDER BY timestamp, seq) AS third, first_value(price) OVER (PARTITION BY symbol ORDER BY timestamp, seq ROWS 9 PRECEDING) AS oldest, last_value(price) OVER (PARTITION BY symbol ORDER BY timestamp, seq ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS ahead FROM ticks")
register("log_exp_negative", lambda s, d: trades(s, d).select("seq", F.round(F.log(F.col("price") + 1), 9).alias("l"), F.round(F.exp(F.col("volume") / 100), 9).alias("e"), F.negative("price").alias("n"), F.signum(F.col("price") - 5000).cast("int").alias("s")), "SELECT seq, round(ln(price + 1), 9) AS l, round(exp(volume / 100.0), 9) AS e, -price AS n, CAST(sign(price - 5000) AS INTEGER) AS s FROM trades")
register("approx_distinct", lambda s, d: ticks(s, d).groupBy("kind").agg(F.approx_count_distinct("price", 0.01).alias("about"), F.countDistinct("price").alias("n")).select("kind", "n", (F.abs(F.col("about") - F.col("n")) <= 0.06 * F.col("n")).alias("close")), "SELECT kind, count(DISTINCT price) AS n, true AS close FROM ticks GROUP BY kind")
for how in ("inner", "left", "right", "full"):
    register(
        f"join_many_{how}",
        lambda s, d, how=how: with_nulls(s, d).where("kind = 'purchase' and symbol < 40").select("symbol", "k", F.col("seq").alias("a")).join(with_nulls(s, d).where("kind = 'error' and symbol > 20 and symbol < 60").select("symbol", "k", F.col("seq").alias("b")), ["symbol", "k"], how).select("a", "b"),
        f"SELECT a.seq AS a, b.seq AS b FROM (SELECT * FROM ({NULLS}) WHERE kind = 'purchase' AND symbol < 40) a {how} JOIN (SELECT * FROM ({NULLS}) WHERE kind = 'error' AND symbol > 20 AND symbol < 60) b ON a.symbol = b.symbol AND a.k = b.k",
    )
register("rollup_sets", lambda s, d: ticks(s, d).rollup("symbol", "kind").agg(F.count("*").alias("n"), F.grouping_id().alias("level")), "SELECT symbol, kind, count(*) AS n, CAST(grouping(symbol) * 2 + grouping(kind) AS BIGINT) AS level FROM ticks GROUP BY ROLLUP (symbol, kind)")
in_dialect("sql_set_chain", "SELECT volume FROM ticks WHERE kind = 'click' INTERSECT SELECT volume FROM trades EXCEPT SELECT volume FROM ticks WHERE price > 9900 ORDER BY volume", "SELECT volume FROM ticks WHERE kind = 'click' INTERSECT SELECT volume FROM trades EXCEPT SELECT volume FROM ticks WHERE price > 9900")
in_dialect("sql_subqueries", "SELECT seq, price, (SELECT max(bid) FROM quotes) AS top FROM trades t WHERE symbol IN (SELECT symbol FROM ticks WHERE kind = 'error' AND volume > 90) AND EXISTS (SELECT 1 FROM quotes q WHERE q.symbol = t.symbol AND q.bid > 9000)", "SELECT seq, price, (SELECT max(bid) FROM quotes) AS top FROM trades t WHERE symbol IN (SELECT symbol FROM ticks WHERE kind = 'error' AND volume > 90) AND EXISTS (SELECT 1 FROM quotes q WHERE q.symbol = t.symbol AND q.bid > 9000)")
# --- q ---------------------------------------------------------------------------------------------
in_q("q_bars", "select open:first price,high:max price,low:min price,close:last price,volume:sum volume,n:count i by symbol,bar:0D00:05 xbar timestamp from trades where price>1000", f"SELECT symbol, timestamp // {BAR} * {BAR} AS bar, arg_min(price, (timestamp, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (timestamp, seq)) AS close, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS n FROM trades WHERE price > 1000 GROUP BY ALL")
in_q("q_asof", "aj[`symbol`timestamp;trades;quotes]", "SELECT t.*, q.bid, q.ask FROM trades t ASOF JOIN quotes q ON t.symbol = q.symbol AND t.timestamp >= q.timestamp")
in_q("q_filter_by", "select symbol,seq,price from trades where volume within 10 90,price=(max;price) fby symbol", "SELECT symbol, seq, price FROM trades WHERE volume BETWEEN 10 AND 90 QUALIFY price = max(price) OVER (PARTITION BY symbol)")
in_q("q_last_rows", "select by symbol from trades", "SELECT * FROM trades QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC, seq DESC) = 1")
in_q("q_update", "update total:sum volume,change:deltas price by symbol from trades where volume>50", "SELECT *, CASE WHEN volume > 50 THEN CAST(sum(volume) OVER (PARTITION BY symbol, volume > 50) AS BIGINT) END AS total, CASE WHEN volume > 50 THEN price - lag(price, 1, 0) OVER (PARTITION BY symbol, volume > 50 ORDER BY timestamp, seq) END AS change FROM trades")
in_q("q_moving", "select seq,top:5 mmax price,total:sums volume by symbol from trades", "SELECT symbol, seq, max(price) OVER (PARTITION BY symbol ORDER BY timestamp, seq ROWS 4 PRECEDING) AS top, CAST(sum(volume) OVER (PARTITION BY symbol ORDER BY timestamp, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM trades")
in_q("q_functions", "select seq, net:{[p;v]t:p*v;t-p}[price;volume], more:{x+1} each volume from trades where price>5000", "SELECT seq, price * volume - price AS net, volume + 1 AS more FROM trades WHERE price > 5000")
in_q("q_lists", "select symbol, n:count each p, top:max each p from (select p:asc price by symbol from trades)", "SELECT symbol, count(*) AS n, max(price) AS top FROM trades GROUP BY symbol")
