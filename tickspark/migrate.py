"""python -m tickspark.migrate: q to SQL or PySpark, queries and tables for other databases, splayed folders to Parquet."""

from __future__ import annotations

import argparse

from tickspark.plans import foreign, q


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tickspark-migrate")
    sub = parser.add_subparsers(dest="what", required=True)
    p = sub.add_parser("q", help="translate a q query")
    p.add_argument("text")
    p.add_argument("--to", choices=("sql", "pyspark"), default="sql")
    p = sub.add_parser("query", help="the dialect's SQL for another database")
    p.add_argument("text")
    p.add_argument("--to", choices=foreign.TARGETS, required=True)
    p = sub.add_parser("table", help="statements that make a market table")
    p.add_argument("name", choices=("trades", "quotes", "orderbook"))
    p.add_argument("--to", choices=foreign.TARGETS, required=True)
    p.add_argument("--ttl-days", type=int)
    p = sub.add_parser("splayed", help="write a splayed table as tick storage or plain Parquet")
    p.add_argument("root")
    p.add_argument("table")
    p.add_argument("out")
    a = parser.parse_args(arguments)
    if a.what == "q":
        print(q.to_pyspark(a.text) if a.to == "pyspark" else q.translate(a.text))
    elif a.what == "query":
        print(foreign.query_text(a.text, a.to))
    elif a.what == "table":
        print(foreign.create_table(a.name, foreign.market_schema(a.name), a.to, ttl_days=a.ttl_days))
        if a.to == "timescale":
            print("\n".join(foreign.hypertable(a.name, retain_days=a.ttl_days)))
    else:
        from tickspark.session import local_session
        from tickspark.sources.splayed import read_splayed

        read_splayed(local_session(), a.root, a.table).write.mode("errorifexists").option("compression", "zstd").parquet(a.out)


if __name__ == "__main__":
    main()
