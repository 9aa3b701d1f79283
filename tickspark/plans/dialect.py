"""A SQL dialect over Spark SQL: time-series joins and functions that Spark lacks become Spark plans.

Rewritten calls: xbar, vwap, first, last (by timestamp, then seq where the table has it), delta, ratio,
epoch_s, epoch_ms, now, substr on numbers, wj_*, ema. Joins: ASOF, AJ0, WINDOW, UNION, PLUS. All else is
Spark SQL as it is, so CTEs, subqueries, set operations and windows come from Catalyst.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.functions.scalars import UNIT_NS
from tickspark.operators import joins, windows
from tickspark.operators.windows import RATIO_UNIT
from tickspark.plans import lexer

_JOIN = re.compile(
    r"\bFROM\s+(?P<left>\w+)(?:\s+(?:AS\s+)?(?P<a>(?!ASOF\b|AJ0\b|WINDOW\b|UNION\b|PLUS\b)\w+))?\s+(?P<kind>ASOF|AJ0|WINDOW|UNION|PLUS)\s+JOIN\s+(?P<right>\w+)"
    r"(?:\s+(?:AS\s+)?(?P<b>(?!ON\b|WHERE\b|GROUP\b|ORDER\b|LIMIT\b)\w+))?(?:\s+ON\s+(?P<on>.*?))?(?=\s+(?:WHERE|GROUP|HAVING|ORDER|LIMIT|(?:ASOF|AJ0|WINDOW|UNION|PLUS|INNER|LEFT|RIGHT|FULL|CROSS)\s+(?:OUTER\s+)?JOIN|JOIN)\b|\s*\)|\s*;?\s*$)",
    re.I | re.S,
)
_EMA = re.compile(r"\bema\s*\(", re.I)
_EQUAL = re.compile(r"(\w+)\.(\w+)\s*=\s*(\w+)\.(\w+)")
_ORDERED = re.compile(r"(\w+)\.(\w+)\s*(>=|>|<=|<)\s*(\w+)\.(\w+)")
_BETWEEN = re.compile(r"(\w+)\.(\w+)\s+BETWEEN\s+(\w+)\.(\w+)\s*([-+]\s*\d+)?\s+AND\s+(\w+)\.(\w+)\s*([-+]\s*\d+)?", re.I)
_WJ = re.compile(r"'(?:[^']|'')*'|\bwj_\w+\s*\(", re.I)
_WJ_CALL = re.compile(r"wj_(avg|sum|count|min|max)\s*\(\s*(?:(\w+)\.)?(\w+)\s*\)", re.I)


def split_arguments(text: str) -> list[str]:
    """Cuts at commas outside parentheses and quotes."""
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "," and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()] if text[start:].strip() or out else []


def _closing(text: str, start: int) -> int:
    depth, quote = 0, ""
    for i in range(start, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return i
    raise ValueError(f"no closing parenthesis: {text[start : start + 40]}")


def _over(text: str, at: int) -> tuple[str, int]:
    """The OVER clause that starts at a place, if any, and its end."""
    m = re.compile(r"\s*OVER\s*\(", re.I).match(text, at)
    if not m:
        return "", at
    end = _closing(text, m.end() - 1) + 1
    return text[at:end], end


def rewrite(sql: str, order: str = "timestamp, seq") -> str:
    """Calls of the dialect's functions as Spark SQL. order: what FIRST and LAST go by."""
    calls: dict[str, Callable[[list[str], str], str]] = {
        "xbar": lambda a, w: f"((({a[0]}) div ({a[1]})) * ({a[1]}))",
        "vwap": lambda a, w: f"(CASE WHEN sum({a[1]}){w} > 0 THEN sum(({a[0]}) * ({a[1]})){w} / sum({a[1]}){w} END)",
        "first": lambda a, w: f"min_by({a[0]}, struct({order}))" if not w else f"first({a[0]}){w}",
        "last": lambda a, w: f"max_by({a[0]}, struct({order}))" if not w else f"last({a[0]}){w}",
        "delta": lambda a, w: f"(({a[0]}) - lag({a[0]}, 1, 0){w})",
        "ratio": lambda a, w: f"(CASE WHEN row_number(){w} = 1 THEN {RATIO_UNIT}L WHEN lag({a[0]}){w} = 0 THEN 0L ELSE cast(({a[0]}) / nullif(lag({a[0]}){w}, 0) * {RATIO_UNIT} AS bigint) END)",
        "epoch_s": lambda a, w: f"(({a[0]}) div {UNIT_NS['s']})",
        "epoch_ms": lambda a, w: f"(({a[0]}) div {UNIT_NS['ms']})",
        "now": lambda a, w: "(unix_micros(current_timestamp()) * 1000)",
        "date_trunc": lambda a, w: f"((({a[1]}) div {UNIT_NS[a[0].strip(chr(39)).lower()]}) * {UNIT_NS[a[0].strip(chr(39)).lower()]})",
        "substr": lambda a, w: f"coalesce(try_cast(substring(cast({a[0]} AS string), greatest({a[1]}, 1){', ' + a[2] if len(a) > 2 else ''}) AS bigint), 0)",
    }
    name = re.compile(r"'(?:[^']|'')*'|\b(" + "|".join(calls) + r")\s*\(", re.I)
    out, at = [], 0
    while m := name.search(sql, at):
        if not m[1]:
            out.append(sql[at : m.end()])
            at = m.end()
            continue
        end = _closing(sql, m.end() - 1)
        window, after = _over(sql, end + 1)
        arguments = [rewrite(a, order) for a in split_arguments(sql[m.end() : end])]
        out += [sql[at : m.start()], calls[m[1].lower()](arguments, window)]
        at = after
    return "".join([*out, sql[at:]])


def _window_calls(sql: str, b: str) -> tuple[list[str], str]:
    """The distinct columns of the wj_ calls, and the statement with each call as its column of the join: wj_max, or wj_max_bid where there are several."""
    calls = []
    for m in _WJ.finditer(sql):
        if m[0][0] != "'":
            call = _WJ_CALL.match(sql, m.start())
            if not call or (call[2] or b).lower() != b.lower():
                raise ValueError(f"WINDOW JOIN takes wj_avg, wj_sum, wj_count, wj_min and wj_max of a column of {b}: {sql[m.start() : m.start() + 40]}")
            calls.append(call)
    columns = list(dict.fromkeys(c[3].lower() for c in calls))
    for c in reversed(calls):
        end = f"_{c[3]}" if len(columns) > 1 else ""
        sql = sql[: c.start()] + f"wj_{c[1]}{end}".lower() + sql[c.end() :]
    return columns, sql


def _window_bounds(on: str, a: str, b: str) -> tuple[str, str, int, int]:
    """Time of the left side and of the right, nanoseconds before and after; an ON clause that says more is refused."""
    t = _BETWEEN.search(on)
    if not t or (t[1].lower(), t[3].lower(), t[6].lower(), t[7].lower()) != (b.lower(), a.lower(), a.lower(), t[4].lower()):
        raise ValueError(f"WINDOW JOIN needs a time of {b} BETWEEN a time of {a} - N AND the same + N")
    rest = _EQUAL.sub(" ", on[: t.start()] + " " + on[t.end() :])
    if re.sub(r"\bAND\b", " ", rest, flags=re.I).strip():
        raise ValueError(f"WINDOW JOIN takes equalities and one BETWEEN of whole numbers, not {' '.join(rest.split())}")
    low, high = (int("".join((x or "0").split())) for x in (t[5], t[8]))
    if low > high:
        raise ValueError(f"WINDOW JOIN from {low} to {high} holds no time")
    return t[4], t[2], -low, high


def _joined(spark: SparkSession, m: re.Match, sql: str) -> tuple[DataFrame, str]:
    """The join's rows, each side also as a struct under its alias, and the statement with wj_ calls named."""
    left, right = spark.table(m["left"]), spark.table(m["right"])
    a, b, kind, on = m["a"] or m["left"], m["b"] or m["right"], m["kind"].upper(), m["on"] or ""
    # a left side that is a join itself has structs of its sides already, and any alias but the right one names it
    sides = [F.col(c) for c, t in left.dtypes if t.startswith("struct")]
    plain = [c for c, t in left.dtypes if not t.startswith("struct")]
    own = [] if sides else [F.struct(*plain).alias(a)]
    if kind == "UNION":
        return joins.union_join(left, right), sql
    keys = [(x[3], x[1]) if x[0].lower() == b.lower() else (x[1], x[3]) for x in _EQUAL.findall(on)]
    if not keys:
        raise ValueError(f"{kind} JOIN needs an equality between {a} and {b}")
    for mine, theirs in keys:
        if mine != theirs:
            right = right.withColumnRenamed(theirs, mine)
    names = [k for k, _ in keys]
    if kind == "PLUS":
        order = next((c for c in ("seq", "timestamp") if c in right.columns), right.columns[0])
        return joins.plus_join(left, right, names, order), sql
    if kind == "WINDOW":
        mine, theirs, before, after = _window_bounds(on, a, b)
        columns, sql = _window_calls(sql, b)
        if not columns:
            raise ValueError("WINDOW JOIN needs a wj_ aggregate")
        value = columns if len(columns) > 1 else columns[0]
        out = joins.window_join(left, right, names, mine, theirs, value, before, after)
        return out.select("*", *own), sql
    t = _ORDERED.search(on)
    if not t:
        raise ValueError(f"{kind} JOIN needs a time order between {a} and {b}")
    rest = _ORDERED.sub(" ", _EQUAL.sub(" ", on))
    if re.sub(r"\bAND\b", " ", rest, flags=re.I).strip() or len(_ORDERED.findall(on)) > 1:
        raise ValueError(f"{kind} JOIN takes equalities and one order of times, not {' '.join(on.split())}")
    turned = t[1].lower() == b.lower()
    mine, theirs = (t[5], t[2]) if turned else (t[2], t[5])
    # t >= q takes the last q up to t, > the last before it; <= and < the first one from t on, or after it
    order = {">=": "<=", ">": "<", "<=": ">=", "<": ">"}[t[3]] if turned else t[3]
    payload = [c for c in right.columns if c not in names]
    renamed = right.select(*names, *(F.col(c).alias(f"_r_{c}") for c in payload))
    ties = "_r_seq" if "seq" in payload else None
    out = joins.asof_join(left, renamed, names, mine, f"_r_{theirs}", [f"_r_{c}" for c in payload], ties=ties, forward=order[0] == "<", strict=len(order) == 1)
    if kind == "AJ0":
        return out.select(*left.columns, *own), sql
    rest = [F.col(f"_r_{c}").alias(c) for c in payload if c not in left.columns]
    return out.select(*plain, *rest, *sides, *own, F.struct(*names, *(F.col(f"_r_{c}").alias(c) for c in payload)).alias(b)), sql


def _with_averages(spark: SparkSession, text: str, order: str) -> str:
    """The statement with its EMA calls as columns of a view: a recurrence is no window function of Spark, so it runs over the filtered rows beforehand."""
    m = re.fullmatch(r"(?P<head>\s*SELECT\s.*?)\bFROM\s+(?P<table>\w+)(?:\s+WHERE\s+(?P<where>.*?))?(?P<tail>\s+(?:ORDER|LIMIT)\b.*|\s*;?\s*)", text, re.I | re.S)
    if not m:
        raise ValueError("EMA takes SELECT … FROM a table, with WHERE, ORDER BY and LIMIT at most")
    head, made = m["head"], []
    frame = spark.sql(rewrite(f"SELECT * FROM {m['table']}{f' WHERE {m["where"]}' if m['where'] else ''}", order))
    while call := _EMA.search(head):
        end = _closing(head, call.end() - 1)
        window, after = _over(head, end + 1)
        arguments = split_arguments(head[call.end() : end])
        w = re.fullmatch(r"\s*OVER\s*\(\s*(?:PARTITION\s+BY\s+(.*?)\s*)?(?:ORDER\s+BY\s+(.*?)\s*)?\)", window, re.I | re.S) if window else None
        if len(arguments) != 2 or window and not w:
            raise ValueError("EMA takes a value and a period or factor, over keys and an order")
        keys = split_arguments((w and w[1]) or "")
        by = split_arguments(w[2]) if w and w[2] else [c for c in split_arguments(order) if c in frame.columns]
        name = f"_ema{len(made)}"
        valued = frame.withColumn("_value", F.expr(rewrite(arguments[0], order))).withColumn("_all", F.lit(0))
        factor = windows.alpha_of(int(arguments[1]) if arguments[1].isdigit() else float(arguments[1]))
        frame = windows.ema(valued, "_value", factor, keys or ["_all"], by, name).drop("_value", "_all")
        unnamed = not re.match(r"\s+\w|\s*[-+*/)]", head[after:])
        head = head[: call.start()] + name + (" AS ema " if unnamed else "") + head[after:]
        made.append(name)
    head = re.sub(r"\*\s*EXCEPT\s*\(", f"* EXCEPT ({', '.join(made)}, ", head, flags=re.I) if re.search(r"\*\s*EXCEPT", head, re.I) else re.sub(r"(SELECT\s+|,\s*)\*(?=\s*(?:,|$))", rf"\g<1>* EXCEPT ({', '.join(made)})", head, flags=re.I)
    view = f"averaged_{uuid.uuid4().hex}"
    frame.createOrReplaceTempView(view)
    return f"{head} FROM {view}{m['tail']}"


_KINDS = frozenset(("asof", "aj0", "window", "union", "plus"))
_AFTER_TABLE = frozenset("where group having order limit on using join inner left right full cross outer semi anti lateral window asof aj0 union plus intersect except minus tablesample pivot".split())


def _has_join(parts: list[lexer.Token]) -> bool:
    words = [t.word() for t in parts if t.kind != "space"]
    return any(a in _KINDS and b == "join" for a, b in zip(words, words[1:], strict=False))


def _stored(spark: SparkSession, frame: DataFrame) -> str:
    view = f"part_{uuid.uuid4().hex}"
    frame.createOrReplaceTempView(view)
    return view


def _named_parts(spark: SparkSession, parts: list[lexer.Token], order: str, known: dict[str, str]) -> str:
    """The statement with its CTEs and its subqueries as views, so that a time-series join finds names alone; known: views by CTE."""
    out: list[str] = []
    i, known = 0, dict(known)
    while i < len(parts) and parts[i].kind == "space":
        i += 1
    if i < len(parts) and parts[i].word() == "with":
        i += 1
        while True:
            while parts[i].kind == "space":
                i += 1
            name = parts[i].text.strip("`").lower()
            start = next(k for k in range(i + 1, len(parts)) if parts[k].text == "(")
            end = lexer.closing(parts, start)
            known[name] = _stored(spark, _run(spark, parts[start + 1 : end], order, known))
            i = end + 1
            while i < len(parts) and parts[i].kind == "space":
                i += 1
            if i >= len(parts) or parts[i].text != ",":
                break
            i += 1
    table = False  # whether a table's name comes next
    while i < len(parts):
        t = parts[i]
        if t.text == "(":
            end = lexer.closing(parts, i)
            inner = parts[i + 1 : end]
            first = next((x.word() for x in inner if x.kind != "space"), "")
            if first in ("select", "with") and (table or _has_join(inner)):
                view = _stored(spark, _run(spark, inner, order, known))
                out.append(view if table else f"(SELECT * FROM {view})")
            else:
                out += ["(", _named_parts(spark, inner, order, known), ")"]
            i, table = end + 1, False
            continue
        if table and t.kind == "name" and t.word() not in ("lateral", "unnest"):
            view = known.get(t.text.strip("`").lower())
            after = next((x for x in parts[i + 1 :] if x.kind != "space"), None)
            aliased = after is not None and after.kind == "name" and (after.word() == "as" or after.word() not in _AFTER_TABLE)
            out.append(t.text if view is None else view if aliased else f"{view} AS {t.text}")
            table = False
        else:
            out.append(t.text)
            if t.kind != "space":
                table = t.word() in ("from", "join")
        i += 1
    return "".join(out)


def _run(spark: SparkSession, parts: list[lexer.Token], order: str, known: dict[str, str]) -> DataFrame:
    text = _named_parts(spark, parts, order, known) if known or _has_join(parts) else lexer.text_of(parts)
    if _EMA.search(text):
        text = _with_averages(spark, text, order)
    while m := _JOIN.search(text):
        frame, text = _joined(spark, m, text)
        m = _JOIN.search(text)
        view = _stored(spark, frame)
        if re.search(r"SELECT\s+\*\s+FROM", text[: m.start() + 5], re.I) and not re.match(r"\s+(?:ASOF|AJ0|WINDOW|UNION|PLUS)\s+JOIN\b", text[m.end() :], re.I):
            flat = ", ".join(f"`{c}`" for c, kind in frame.dtypes if not kind.startswith("struct"))
            text = text[: m.start()].rstrip()[:-1] + flat + " " + text[m.start() :]
            m = _JOIN.search(text)
        text = f"{text[: m.start()]}FROM {view}{text[m.end() :]}"
    parts = lexer.tokens(text)
    return spark.sql(rewrite(lexer.text_of(lexer.whole_division(parts, _reals(spark, parts)) if any(t.text == "/" for t in parts) else parts), order))


def _reals(spark: SparkSession, parts: list[lexer.Token]) -> Callable[[str], bool]:
    """Whether a name is a column, of any table that the statement names, that holds other than whole numbers."""
    found: set[str] = set()
    for name in {t.text.strip("`") for t in parts if t.kind == "name"}:
        if spark.catalog.tableExists(name):
            found |= {c.lower() for c, kind in spark.table(name).dtypes if kind in ("float", "double") or kind.startswith("decimal")}
    return found.__contains__


def sql(spark: SparkSession, text: str, order: str = "timestamp, seq") -> DataFrame:
    """Runs a statement of the dialect over the session's tables and views.

    Time-series joins may stand in CTEs and subqueries, take them as sides, and follow one another in
    a FROM clause, each joining what is left of it. / divides whole numbers toward zero, and gives 0 by
    0; where a side names a column, literal or function of another kind, it is Spark's.
    """
    return _run(spark, lexer.tokens(text), order, {})


def explain(spark: SparkSession, text: str) -> str:
    """The formatted physical plan; nothing runs."""
    return sql(spark, text)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
