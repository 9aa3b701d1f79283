"""Decoders of feed messages, as column expressions: JSON ticks and FIX."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JSON_TICK = "symbol_id long, price long, volume long, ts long"
JSON_HUMAN = "symbol string, price double, volume long, ts long"
#: Longest message that is read.
MOST_BYTES = 4096


def json_ticks(messages: DataFrame, value: str = "value", human: bool = False, price_scale: float = 10_000.0, arrived: Column | None = None) -> DataFrame:
    """Ticks of JSON messages, with a reason on those that can't be read: send both where they belong by it."""
    x = F.from_json(F.col(value).cast("string"), JSON_HUMAN if human else JSON_TICK)
    out = messages.withColumn("m", x)
    price = (F.col("m.price") * price_scale).cast("long") if human else F.col("m.price")
    symbol = F.col("m.symbol") if human else F.col("m.symbol_id")
    bad = F.when(F.octet_length(F.col(value).cast("binary")) > MOST_BYTES, "too long").when(symbol.isNull() | F.col("m.price").isNull() | F.col("m.volume").isNull(), "missing field")
    at = F.coalesce("m.ts", arrived if arrived is not None else F.unix_micros(F.current_timestamp()) * 1000)
    return out.select(symbol.alias("symbol"), at.alias("timestamp"), price.alias("price"), F.col("m.volume").alias("volume"), bad.alias("reason"))


#: FIX tags.
TAGS = {"type": "35", "symbol": "55", "price": "44", "last_price": "31", "quantity": "38", "last_quantity": "32", "side": "54", "order_id": "37", "sequence": "34", "sent": "52", "bid": "132", "ask": "133", "bid_size": "134", "ask_size": "135"}


def fix_fields(message: Column) -> Column:
    """Tag to value of a message whose fields end with SOH; of a repeated tag the last value."""
    pairs = F.filter(F.split(message, "\x01"), lambda x: x.contains("="))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != F.substring_index(x, "=", 1)), F.create_map(F.substring_index(x, "=", 1), F.regexp_extract(x, "^[^=]*=(?s)(.*)$", 1))))


def fix_messages(messages: DataFrame, value: str = "value") -> DataFrame:
    """Typed fields of FIX messages; kind is tick, quote, order or other."""
    f = messages.withColumn("f", fix_fields(F.col(value)))
    tag = lambda name: F.get(F.map_values(F.map_filter(F.col("f"), lambda k, _: k == TAGS[name])), F.lit(0))
    kind = F.when(tag("type") == "W", "quote").when(tag("type") == "D", "order").when(tag("type").isin("8", "X"), "tick").otherwise("other")
    number = lambda name, to="double": tag(name).try_cast(to)
    return f.select(
        kind.alias("kind"), tag("symbol").alias("symbol"), F.coalesce(number("last_price"), number("price")).alias("price"), F.coalesce(number("last_quantity"), number("quantity")).cast("long").alias("volume"),
        F.when(tag("side") == "1", "buy").when(tag("side") == "2", "sell").alias("side"), tag("order_id").alias("order_id"), number("sequence", "bigint").alias("sequence"), number("bid").alias("bid"), number("ask").alias("ask"),
    )


def crypto_messages(messages: DataFrame, value: str = "value", price_scale: float = 10_000.0) -> DataFrame:
    """Trades and best prices of a crypto exchange's web socket JSON, bare or under `data`; numbers come as decimal text.

    Fields differ in case alone (t, T), so each is read by its path. kind is trade, quote or other. A
    trade's side is the taker's: it sells where the buyer was the maker.
    """
    text = F.col(value).cast("string")
    body = F.coalesce(F.get_json_object(text, "$.data"), text)
    at = lambda name: F.get_json_object(F.col("body"), f"$.{name}")
    price = lambda name: F.round(at(name).try_cast("double") * price_scale).cast("long")
    kind = F.when(at("e").isin("trade", "aggTrade"), "trade").when(at("b").isNotNull() & at("a").isNotNull() & at("u").isNotNull(), "quote").otherwise("other")
    out = messages.withColumn("body", body).select(
        kind.alias("kind"), at("s").alias("symbol"), (at("T").try_cast("long") * 1_000_000).alias("timestamp"), price("p").alias("price"), at("q").try_cast("double").alias("size"),
        F.when(at("m") == "true", "sell").when(at("m") == "false", "buy").alias("side"), F.coalesce(at("t"), at("u")).try_cast("long").alias("sequence"),
        price("b").alias("bid"), at("B").try_cast("double").alias("bid_size"), price("a").alias("ask"), at("A").try_cast("double").alias("ask_size"),
    )
    trade = F.col("kind") == "trade"
    return out.select("kind", "symbol", "timestamp", *(F.when(trade, F.col(c)).alias(c) for c in ("price", "size", "side")), "sequence", *(F.when(F.col("kind") == "quote", F.col(c)).alias(c) for c in ("bid", "bid_size", "ask", "ask_size")))
