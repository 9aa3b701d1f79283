"""Results as text, and a command line over a folder of Parquet tables: python -m tickspark.cli FOLDER [-f FORMAT] [SQL].

Without SQL, statements are read from standard input, one a line; `\\t SQL` times one, `\\q QUERY`
takes q, `\\f FORMAT` changes the format. csv, tsv and json hold all rows, read a partition at a time;
pretty, whose widths need the rows at once, shows PRETTY of them. `-n ROWS` sets another limit, for any
format; what it cuts is marked as truncated (csv and tsv have no place for a mark but standard error).
"""

from __future__ import annotations

import argparse
import csv
import io
import json
import os
import sys
import time
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from tickspark.plans import ddl, dialect, q

FORMATS = ("pretty", "csv", "tsv", "json")
#: Rows that the pretty format shows unless told otherwise.
PRETTY = 1000


def pieces(df: DataFrame, form: str = "pretty", limit: int | None = None) -> Iterator[str]:
    """The result as text, in parts; without a limit all rows of csv, tsv and json, and PRETTY of pretty."""
    if form not in FORMATS:
        raise ValueError(f"a format is one of {', '.join(FORMATS)}")
    if limit is None and form == "pretty":
        limit = PRETTY
    names, n, cut = df.columns, 0, False
    found = (list(r) for r in (df if limit is None else df.limit(limit + 1)).toLocalIterator())
    if form == "pretty":
        rows = list(found)
        cut, rows = len(rows) > limit, rows[:limit]
        cells = [["NULL" if v is None else str(v) for v in r] for r in rows]
        widths = [max([len(x), *(len(r[i]) for r in cells)]) for i, x in enumerate(names)]
        line = lambda values: " | ".join(v.ljust(w) for v, w in zip(values, widths, strict=True)).rstrip()
        yield "\n".join([line(names), "-+-".join("-" * w for w in widths), *map(line, cells), f"({len(rows)} rows{', truncated' if cut else ''})"])
        return

    def written(row: list) -> str:
        out = io.StringIO()
        csv.writer(out, delimiter="," if form == "csv" else "\t", lineterminator="").writerow(row)
        return out.getvalue()

    yield f'{{"columns": {json.dumps(names)}, "data": [' if form == "json" else written(names)
    for row in found:
        if n == limit:
            cut = True
            break
        if form == "json":
            yield (", " if n else "") + json.dumps(row, default=str)
        else:
            yield "\n" + written(row)
        n += 1
    if form == "json":
        yield f'], "rows": {n}' + (', "truncated": true}' if cut else "}")
    elif cut:
        print(f"truncated after {n} rows", file=sys.stderr)


def formatted(df: DataFrame, form: str = "pretty", limit: int | None = None) -> str:
    return "".join(pieces(df, form, limit))


def answer(spark: SparkSession, statement: str, form: str = "pretty", limit: int | None = None) -> Iterator[str]:
    """What a statement prints, in parts; DDL prints ok."""
    statement = statement.strip()
    words = statement.split(None, 1)
    if statement.startswith("\\t "):
        start = time.perf_counter()
        yield from answer(spark, statement[3:], form, limit)
        yield f"\n{(time.perf_counter() - start) * 1000:.1f} ms"
    elif statement.startswith("\\q "):
        yield from pieces(q.run(spark, statement[3:]), form, limit)
    elif words and words[0].upper() in ("CREATE", "DROP", "ALTER"):
        ddl.execute(spark, statement)
        yield "ok"
    elif words and words[0].upper() == "EXPLAIN":
        yield dialect.explain(spark, words[1])
    else:
        yield from pieces(dialect.sql(spark, statement.rstrip(";")), form, limit)


def respond(spark: SparkSession, statement: str, form: str = "pretty", limit: int | None = None) -> str:
    return "".join(answer(spark, statement, form, limit))


def _answers(spark: SparkSession, lines: Iterable[str], form: str, limit: int | None) -> Iterator[Iterator[str]]:
    def safe(text: str, form: str) -> Iterator[str]:
        begun = False
        try:
            for piece in answer(spark, text, form, limit):
                yield piece
                begun = True
        except Exception as e:
            yield f"{chr(10) if begun else ''}error: {str(e).splitlines()[0]}"

    for text in lines:
        if text.startswith("\\f "):
            form = text[3:].strip()
        elif text.strip():
            yield safe(text, form)


def converse(spark: SparkSession, lines: Iterable[str], form: str = "pretty", limit: int | None = None) -> Iterable[str]:
    """Answers to lines; an error answers one line and ends nothing."""
    yield from map("".join, _answers(spark, lines, form, limit))


def main(arguments: list[str] | None = None) -> None:
    from tickspark.session import local_session
    from tickspark.sources.tables import quotes, ticks, trades

    parser = argparse.ArgumentParser(prog="tickspark")
    parser.add_argument("folder")
    parser.add_argument("sql", nargs="?")
    parser.add_argument("-f", "--format", choices=FORMATS, default="pretty")
    parser.add_argument("-n", "--limit", type=int)
    a = parser.parse_args(arguments)
    spark = SparkSession.getActiveSession() or local_session()
    for file in sorted(os.listdir(a.folder)):
        if file.endswith(".parquet"):
            spark.read.parquet(f"{a.folder}/{file}").createOrReplaceTempView(file.removesuffix(".parquet"))
    if spark.catalog.tableExists("events"):
        for name, view in (("ticks", ticks), ("trades", trades), ("quotes", quotes)):
            view(spark, a.folder).createOrReplaceTempView(name)
    for parts in _answers(spark, [a.sql] if a.sql else sys.stdin, a.format, a.limit):
        for piece in parts:
            sys.stdout.write(piece)
        print(flush=True)


if __name__ == "__main__":
    main()
