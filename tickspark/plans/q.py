"""q queries as statements of the SQL dialect, and as PySpark text.

Expressions are read as q reads them: right to left, all infix signs alike. Translated: select, exec,
update and delete with by, where and fby; aj, aj0 and wj over named tables; $[c;a;b]; casts; lists for
in and within; functions in braces, called with arguments or by each, whose statements but the last name
values. update and delete give the changed rows as a query and change no table. Dates and times become
nanoseconds. Moving and running functions go by `order` within the keys of by; lists of a group's values
(asc, desc, reverse, raze) stand under by.
"""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from tickspark.plans import dialect

_TOKENS = re.compile(
    r"""(?P<space>\s+(?:/[^\n]*)?)|(?P<string>"(?:[^"\\]|\\.)*")|(?P<symbols>(?:`[\w.]*)+)
    |(?P<time>\d{4}\.\d\d\.\d\d(?:D[\d:.]+)?|\d+D(?:\d\d:\d\d(?::\d\d(?:\.\d+)?)?)?|\d\d:\d\d(?::\d\d(?:\.\d+)?)?)
    |(?P<number>(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?[hijfe]?)|(?P<name>[A-Za-z][\w.]*)|(?P<op>\+\\:|<=|>=|<>|[-+*%=<>&|~$,;:()\[\]{}])""",
    re.X,
)
AGGREGATES = {"sum": "sum", "avg": "avg", "min": "min", "max": "max", "count": "count", "first": "first", "last": "last", "med": "median", "var": "var_pop", "dev": "stddev_pop", "svar": "var_samp", "sdev": "stddev_samp"}
SCALARS = {"abs": "abs", "sqrt": "sqrt", "floor": "floor", "ceiling": "ceil", "log": "ln", "exp": "exp", "neg": "negative", "null": "isnull", "not": "not", "upper": "upper", "lower": "lower", "signum": "sign", "string": "string", "sin": "sin", "cos": "cos", "tan": "tan"}
SHIFTS = {"prev": "lag({0}, 1){w}", "next": "lead({0}, 1){w}", "deltas": "delta({0}){w}", "ratios": "ratio({0}){w}"}
#: What `f each` makes of a column of lists, for functions that would otherwise take the column as a whole.
OF_LISTS = {"count": "size({0})", "first": "try_element_at({0}, 1)", "last": "try_element_at({0}, -1)", "min": "array_min({0})", "max": "array_max({0})", "distinct": "array_distinct({0})", "sum": "aggregate({0}, 0D, (s, v) -> s + coalesce(v, 0))"}
#: Under by: lists of a group's values.
LISTS = {"asc": "sort_array(collect_list({0}))", "desc": "sort_array(collect_list({0}), false)", "raze": "flatten(transform(array_sort(collect_list(struct({order}, {0} AS _v))), r -> r._v))", "reverse": "reverse(transform(array_sort(collect_list(struct({order}, {0} AS _v))), r -> r._v))"}
#: A running product by logarithms, so exact to about twelve digits.
PRODUCT = "(CASE WHEN count_if({0} = 0){w} > 0 THEN 0D WHEN count_if({0} < 0){w} % 2 = 1 THEN -1D ELSE 1D END * coalesce(exp(sum(ln(abs(nullif({0}, 0)))){w}), 1D))"
RUNNING = {"sums": "sum", "mins": "min", "maxs": "max", "avgs": "avg"}
MOVING = {"mavg": "avg", "msum": "sum", "mmin": "min", "mmax": "max", "mdev": "stddev_pop", "mcount": "count"}
INFIX = {"+": "+", "-": "-", "*": "*", "%": "/", "=": "=", "<>": "<>", "<": "<", ">": ">", "<=": "<=", ">=": ">=", "&": "AND", "|": "OR", "~": "<=>", "and": "AND", "or": "OR", "div": "div"}
WORDS = {*MOVING, "xbar", "wavg", "wsum", "in", "within", "like", "ema", "xprev", "mod", "fby", "and", "or", "div"}
CASTS = {"boolean": "boolean", "short": "smallint", "int": "int", "long": "bigint", "real": "float", "float": "double", "symbol": "string", "b": "boolean", "h": "smallint", "i": "int", "j": "bigint", "e": "float", "f": "double", "s": "string"}
OTHERS = {"reciprocal", "distinct", "fills", "rank", "prds", "til", "enlist", "type"}
DAY_NS = 86_400_000_000_000


@dataclass
class Token:
    kind: str
    text: str


@dataclass
class Term:
    """An expression in SQL; kind is row, agg or window; items are those of a list."""

    sql: str
    name: str = "x"
    kind: str = "row"
    items: list[str] = field(default_factory=list)


@dataclass
class Query:
    verb: str
    items: list[tuple[str, Term]]
    by: list[tuple[str, Term]]
    source: str
    where: list[Term]
    fby: list[str]


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKENS.match(text, at)
        if not m:
            raise ValueError(f"can't read: {text[at : at + 20]}")
        adjacent = out and out[-1].text == "-" and out[-1].kind == "op" and m.lastgroup == "number"
        if adjacent and (len(out) < 2 or out[-2].kind == "space" or out[-2].text in "([;,:=<>+*%"):
            out[-1] = Token("number", "-" + m[0])  # a sign that touches its number and follows a gap
        else:
            out.append(Token(m.lastgroup, m[0]))
        at = m.end()
    return [t for t in out if t.kind != "space"]


def nanos(text: str) -> int:
    """A date, time or span as nanoseconds; dates since 1970."""
    day, _, clock = text.partition("D") if "D" in text else (text, "", "") if ":" not in text else ("0", "", text)
    days = (datetime.date(*map(int, day.split("."))) - datetime.date(1970, 1, 1)).days if "." in day else int(day)
    total = days * DAY_NS
    whole, _, part = clock.partition(".")
    for value, unit in zip(whole.split(":") if whole else [], (3600, 60, 1), strict=False):
        total += int(value) * unit * 1_000_000_000
    return total + int((part + "0" * 9)[:9])


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _cut(ts: list[Token], sign: str) -> list[list[Token]]:
    """Cuts at a sign outside brackets."""
    out, depth = [[]], 0
    for t in ts:
        depth += (t.kind == "op" and t.text in "([{") - (t.kind == "op" and t.text in ")]}")
        if t.kind == "op" and t.text == sign and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return [] if out == [[]] else out


class Reader:
    """Reads one expression. spread: aggregates go over the keys' rows and keep them all, as in update."""

    def __init__(self, ts: list[Token], keys: str, order: str, fby: list[str], spread: bool = False, given: dict[str, Term] | None = None):
        self.ts, self.at, self.keys, self.order, self.fby, self.spread, self.given = ts, 0, keys, order, fby, spread, given or {}

    def window(self, frame: str = "") -> str:
        return f" OVER ({f'PARTITION BY {self.keys} ' if self.keys else ''}ORDER BY {self.order}{f' ROWS BETWEEN {frame}' if frame else ''})"

    def aggregate(self, call: str, name: str) -> Term:
        if not self.spread:
            return Term(call, name, "agg")
        if call.startswith(("first(", "last(")):
            return Term(call + self.window("UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"), name, "window")
        return Term(f"{call} OVER ({f'PARTITION BY {self.keys}' if self.keys else ''})", name, "window")

    def inner(self, ts: list[Token]) -> Term:
        return Reader(ts, self.keys, self.order, self.fby, self.spread, self.given).all()

    def call(self, body: list[Token], args: list[Term]) -> Term:
        """The value of a function in braces: of x, y and z, unless it names its own."""
        names, statements = ["x", "y", "z"][: len(args)], _cut(body, ";")
        if body and body[0].text == "[":
            end = next(i for i, t in enumerate(body) if t.text == "]")
            names, statements = [p[0].text for p in _cut(body[1:end], ";")], _cut(body[end + 1 :], ";")
        elif any(t.text in ("x", "y", "z")[len(args) :] for t in body):
            raise ValueError(f"a function called with {len(args)} values uses more")
        if len(names) != len(args) or not statements:
            raise ValueError(f"a function of {len(names)} takes {len(args)} values")
        given = {n: replace(a, sql=f"({a.sql})") for n, a in zip(names, args, strict=True)}
        value = lambda ts: Reader(ts, self.keys, self.order, self.fby, self.spread, given).all()
        for s in statements[:-1]:
            if len(s) < 3 or s[0].kind != "name" or s[1].text != ":":
                raise ValueError("a statement before the last names a value")
            given = given | {s[0].text: replace(value(s[2:]), sql=f"({value(s[2:]).sql})")}
        return value(statements[-1])

    def all(self) -> Term:
        if not self.ts:
            raise ValueError("an expression is missing")
        term = self.expression()
        if self.at < len(self.ts):
            raise ValueError(f"can't read on at {self.ts[self.at].text}")
        return term

    def peek(self) -> Token:
        return self.ts[self.at] if self.at < len(self.ts) else Token("end", "")

    def group(self, close: str) -> list[Token]:
        """Tokens up to the bracket that closes the one just read."""
        depth, start = 1, self.at
        while self.at < len(self.ts):
            t = self.ts[self.at]
            self.at += 1
            depth += (t.kind == "op" and t.text in "([{") - (t.kind == "op" and t.text in ")]}")
            if not depth:
                return self.ts[start : self.at - 1]
        raise ValueError(f"no {close}")

    def expression(self) -> Term:
        left = self.noun()
        t = self.peek()
        if t.kind == "op" and (t.text in INFIX or t.text == "$") or t.kind == "name" and t.text in WORDS:
            self.at += 1
            return self.dyad(t.text, left, self.expression())
        return left

    def noun(self) -> Term:
        t = self.peek()
        self.at += 1
        if t.kind in ("number", "time"):
            values = [t]
            while self.peek().kind in ("number", "time"):
                values.append(self.peek())
                self.at += 1
            items = [str(nanos(v.text)) if v.kind == "time" else v.text.rstrip("hijfe") for v in values]
            return Term(items[0] if len(items) == 1 else f"({', '.join(items)})", items=items)
        if t.kind == "symbols":
            items = [_quoted(x) for x in t.text.split("`")[1:]]
            return Term(items[0] if len(items) == 1 else f"({', '.join(items)})", items=items)
        if t.kind == "bare":
            return Term(t.text, items=[t.text])
        if t.kind == "string":
            return Term(_quoted(t.text[1:-1].replace('\\"', '"')), items=[_quoted(t.text[1:-1])])
        if t.text == "(":
            parts = [self.inner(p) for p in _cut(self.group(")"), ";")]
            if len(parts) == 1:
                return replace(parts[0], sql=f"({parts[0].sql})")
            return Term(f"({', '.join(p.sql for p in parts)})", parts[-1].name, items=[p.sql for p in parts])
        if t.text == "{":
            body = self.group("}")
            if self.peek().text == "[":
                self.at += 1
                return self.call(body, [self.inner(p) for p in _cut(self.group("]"), ";")])
            self.at += self.peek().text == "each"
            return self.call(body, [self.expression()])
        if t.text in self.given:
            return self.given[t.text]
        if t.text == "$" and self.peek().text == "[":
            self.at += 1
            parts = [self.inner(p) for p in _cut(self.group("]"), ";")]
            if len(parts) < 3 or len(parts) % 2 == 0:
                raise ValueError("$[] takes conditions with values, and a last value")
            whens = " ".join(f"WHEN {c.sql} THEN {v.sql}" for c, v in zip(parts[:-1:2], parts[1::2], strict=True))
            return Term(f"CASE {whens} ELSE {parts[-1].sql} END", parts[1].name, _kind(*parts))
        if t.text == "-":
            x = self.expression()
            return replace(x, sql=f"(-{x.sql})")
        if t.kind != "name" or t.text in WORDS and self.peek().text != "[":
            raise ValueError(f"unexpected {t.text or 'end'}")
        if self.peek().text == "[":
            self.at += 1
            parts = [self.inner(p) for p in _cut(self.group("]"), ";")]
            if t.text in WORDS and len(parts) == 2:
                return self.dyad(t.text, *parts)
            if len(parts) == 1:
                return self.monad(t.text, parts[0])
            raise ValueError(f"unknown call of {t.text}")
        if self.peek().text == "each":
            self.at += 1
            x = self.expression()
            return Term(OF_LISTS[t.text].format(x.sql), x.name, x.kind) if t.text in OF_LISTS else self.monad(t.text, x)
        if any(t.text in known for known in (AGGREGATES, SCALARS, SHIFTS, RUNNING, LISTS, OTHERS)):
            return self.monad(t.text, self.expression())
        return Term("*" if t.text == "i" else t.text, t.text)

    def monad(self, f: str, x: Term) -> Term:
        if f in AGGREGATES:
            return self.aggregate(f"{AGGREGATES[f]}({x.sql})", x.name)
        if f == "distinct":
            return Term(f"DISTINCT {x.sql}", x.name)
        if f in LISTS:
            if not self.keys or self.spread:
                raise ValueError(f"{f} stands under by")
            return Term(LISTS[f].format(x.sql, order=self.order), x.name, "agg")
        if f == "til":
            return Term(f"slice(sequence(0, {x.sql}), 1, CAST({x.sql} AS int))", x.name, x.kind)
        if f in ("enlist", "type"):
            return Term(f"{'array' if f == 'enlist' else 'typeof'}({x.sql})", x.name, x.kind)
        if f == "prds":
            return Term(PRODUCT.format(x.sql, w=self.window("UNBOUNDED PRECEDING AND CURRENT ROW")), x.name, "window")
        if f == "reciprocal":
            return Term(f"(1 / {x.sql})", x.name, x.kind)
        if f == "fills":
            return Term(f"last_value({x.sql}, true){self.window('UNBOUNDED PRECEDING AND CURRENT ROW')}", x.name, "window")
        if f == "rank":
            keys = f"PARTITION BY {self.keys} " if self.keys else ""
            return Term(f"(row_number() OVER ({keys}ORDER BY {x.sql}, {self.order}) - 1)", x.name, "window")
        if f in SHIFTS:
            return Term(SHIFTS[f].format(x.sql, w=self.window()), x.name, "window")
        if f in RUNNING:
            return Term(f"{RUNNING[f]}({x.sql}){self.window('UNBOUNDED PRECEDING AND CURRENT ROW')}", x.name, "window")
        if f in SCALARS:
            return Term(f"{SCALARS[f]}({x.sql})", x.name, x.kind)
        raise ValueError(f"unknown function {f}")

    def dyad(self, f: str, a: Term, b: Term) -> Term:
        kind = _kind(a, b)
        if f in INFIX:
            return Term(f"({a.sql} {INFIX[f]} {b.sql})", b.name if b.name != "x" else a.name, kind)
        if f == "$":
            name = a.sql.strip("'")
            if name not in CASTS:
                raise ValueError(f"unknown type {name}")
            return Term(f"CAST({b.sql} AS {CASTS[name]})", b.name, b.kind)
        if f == "xbar":
            return Term(f"xbar({b.sql}, {a.sql})", b.name, kind)
        if f == "wavg":
            return self.aggregate(f"vwap({b.sql}, {a.sql})", b.name)
        if f == "wsum":
            return self.aggregate(f"sum({a.sql} * {b.sql})", b.name)
        if f == "in":
            return Term(f"({a.sql} IN ({', '.join(b.items) or b.sql}))", a.name, kind)
        if f == "within":
            if len(b.items) != 2:
                raise ValueError("within takes two bounds")
            return Term(f"({a.sql} BETWEEN {b.items[0]} AND {b.items[1]})", a.name, kind)
        if f == "like":
            pattern = b.sql.replace("%", r"\%").replace("_", r"\_").replace("*", "%").replace("?", "_")
            return Term(f"(CAST({a.sql} AS string) LIKE {pattern})", a.name, kind)
        if f == "mod":
            return Term(f"pmod({a.sql}, {b.sql})", a.name, kind)
        if f == "xprev":
            return Term(f"lag({b.sql}, {a.sql}){self.window()}", b.name, "window")
        if f == "ema":
            return Term(f"ema({b.sql}, {a.sql}){self.window()}", b.name, "window")
        if f == "fby":
            call, column = (a.items + [""])[:2]
            if call not in AGGREGATES or not column:
                raise ValueError("fby takes (aggregate;column) on its left")
            over = f"OVER (PARTITION BY {b.sql} ORDER BY {self.order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)" if call in ("first", "last") else f"OVER (PARTITION BY {b.sql})"
            self.fby.append(f"{AGGREGATES[call]}({column}) {over}")
            return Term(f"_fby{len(self.fby)}", column, "fby")
        width = int(a.sql)
        return Term(f"{MOVING[f]}({b.sql}){self.window(f'{width - 1} PRECEDING AND CURRENT ROW')}", b.name, "window")


def _kind(*terms: Term) -> str:
    return next((k for k in ("fby", "window", "agg") if any(t.kind == k for t in terms)), "row")


def _fby_list(ts: list[Token]) -> list[Token]:
    """(max;price) has a bare function as an item: it is marked as a name that stands for itself."""
    out = list(ts)
    for i in range(len(ts) - 2):
        if ts[i].text == "(" and ts[i + 1].text in AGGREGATES and ts[i + 2].text == ";":
            out[i + 1] = Token("bare", ts[i + 1].text)
    return out


def parse(text: str, order: str = "timestamp, seq") -> Query:
    ts = _fby_list(tokens(text.strip().rstrip(";")))
    if not ts or ts[0].text not in ("select", "exec", "update", "delete"):
        raise ValueError("a query starts with select, exec, update or delete")
    places, depth = {}, 0
    for i, t in enumerate(ts):
        depth += (t.kind == "op" and t.text in "([{") - (t.kind == "op" and t.text in ")]}")
        if not depth and t.kind == "name" and t.text in ("by", "from", "where") and t.text not in places:
            places[t.text] = i
    if "from" not in places:
        raise ValueError("from is missing")
    start, end = places["from"], places.get("where", len(ts))
    by_at = min(places.get("by", start), start)
    source = ts[start + 1 : end]
    if len(source) == 1 and source[0].kind == "name":
        name = source[0].text
    elif source and source[0].text == "(" and source[-1].text == ")":
        name = "(" + translate(" ".join(t.text for t in source[1:-1]), order) + ")"
    else:
        raise ValueError("from takes a table or a query in parentheses")
    fby: list[str] = []

    def named(part: list[Token], keys: str) -> tuple[str, Term]:
        alias = part[0].text if len(part) > 1 and part[1].text == ":" else ""
        term = Reader(part[2:] if alias else part, keys, order, fby, ts[0].text == "update").all()
        return alias or ("x" if term.name == "i" else term.name), term

    by = [named(p, "") for p in _cut(ts[by_at + 1 : start], ",")]
    conditions = _cut(ts[end + 1 :], ",")
    if "where" in places and not conditions:
        raise ValueError("where has no condition")
    where = [Reader(p, "", order, fby).all() for p in conditions]
    if fby and ts[0].text in ("update", "delete"):
        raise ValueError("fby in update or delete")
    groups = [t.sql for _, t in by]
    if ts[0].text == "update" and where:  # aggregates cover the rows that are changed
        groups.append(f"coalesce({' AND '.join(t.sql for t in where)}, false)")
    keys = ", ".join(groups)
    return Query(ts[0].text, [named(p, keys) for p in _cut(ts[1:by_at], ",")], by, name, where, fby)


def _source(q: Query) -> tuple[str, str]:
    """What to select from, and the condition. Conditions apply one after another: those before an fby narrow its groups."""
    first = next((i for i, t in enumerate(q.where) if t.kind == "fby"), len(q.where))
    before = " AND ".join(t.sql for t in q.where[:first])
    if first == len(q.where):
        return q.source, before
    inner = ", ".join(f"{x} AS _fby{i}" for i, x in enumerate(q.fby, 1))
    rows = f"SELECT *, {inner} FROM {q.source}{f' WHERE {before}' if before else ''}"
    rest = " AND ".join(t.sql for t in q.where[first:])
    return f"(SELECT * EXCEPT ({', '.join(f'_fby{i}' for i in range(1, len(q.fby) + 1))}) FROM ({rows}) WHERE {rest})", ""


def _listed(term: Term, order: str) -> str:
    """Under by, a column that isn't aggregated becomes the list of its values in order."""
    if term.kind == "agg" or term.items:
        return term.sql
    return f"transform(array_sort(collect_list(struct({order}, {term.sql} AS _v))), r -> r._v)"


def _table(name: str) -> str:
    if not re.fullmatch(r"\w+", name):
        raise ValueError(f"joins take named tables, not {name}")
    return name


def _join(text: str) -> str | None:
    m = re.match(r"\s*(aj0|aj|wj1|wj)\s*\[", text)
    if not m:
        return None
    parts = _cut(tokens(text[m.end() : text.rstrip().rstrip(";").rindex("]")]), ";")
    if m[1].startswith("aj"):
        columns, left, right = parts[0][0].text.split("`")[1:], _table(parts[1][0].text), _table(parts[2][0].text)
        on = " AND ".join([*(f"{left}.{c} = {right}.{c}" for c in columns[:-1]), f"{left}.{columns[-1]} >= {right}.{columns[-1]}"])
        return f"SELECT * FROM {left} {'ASOF' if m[1] == 'aj' else 'AJ0'} JOIN {right} ON {on}"
    bounds, columns, left = [t.text for t in parts[0] if t.kind == "number"], parts[1][0].text.split("`")[1:], _table(parts[2][0].text)
    spec = _cut(parts[3][1:-1], ";")
    if len(bounds) != 2 or len(spec) < 2 or int(bounds[0]) > 0 or int(bounds[1]) < 0:
        raise ValueError("wj takes bounds such as -10 10 around each row, and (table;(f;`column))")
    right, calls = _table(spec[0][0].text), []
    for s in spec[1:]:
        f, column = (x[0].text for x in _cut(s[1:-1], ";"))
        calls.append(f"wj_{f}({right}.{column.strip('`')}) AS {column.strip('`')}_{f}")
    on = " AND ".join(f"{left}.{c} = {right}.{c}" for c in columns[:-1])
    time = columns[-1]
    return f"SELECT {left}.*, {', '.join(calls)} FROM {left} WINDOW JOIN {right} ON {on} AND {right}.{time} BETWEEN {left}.{time} - {bounds[0].lstrip('-')} AND {left}.{time} + {bounds[1]}"


def translate(text: str, order: str = "timestamp, seq", columns: list[str] | None = None) -> str:
    """A statement of the dialect. columns: those of the table, by which update knows what it replaces."""
    if joined := _join(text):
        return joined
    q = parse(text, order)
    source, where = _source(q)
    condition = f" WHERE {where}" if where else ""
    if q.verb == "delete":
        if q.items:
            return f"SELECT * EXCEPT ({', '.join(t.sql for _, t in q.items)}) FROM {source}"
        return f"SELECT * FROM {q.source} WHERE NOT coalesce({where}, false)" if where else f"SELECT * FROM {q.source} WHERE false"
    if q.verb == "update":
        own, values = {c.lower() for c in columns or []}, []
        for name, t in q.items:
            old = name if name.lower() in own else "NULL"
            values.append(f"CASE WHEN {where} THEN {t.sql} ELSE {old} END AS {name}" if where else f"{t.sql} AS {name}")
        replaced = [name for name, _ in q.items if name.lower() in own]
        return f"SELECT *{f' EXCEPT ({", ".join(replaced)})' if replaced else ''}, {', '.join(values)} FROM {source}"
    if not q.by:
        return f"SELECT {', '.join(t.sql if t.sql in (n, '*') or t.sql.startswith('DISTINCT ') else f'{t.sql} AS {n}' for n, t in q.items) or '*'} FROM {source}{condition}"
    keys = [f"{t.sql} AS {n}" if t.sql != n else n for n, t in q.by]
    groups = ", ".join(t.sql for _, t in q.by)
    if not q.items:
        return f"SELECT _r.* FROM (SELECT max_by(struct(*), struct({order})) AS _r FROM {source}{condition} GROUP BY {groups})"
    if any(t.kind == "window" for _, t in q.items):
        return f"SELECT {', '.join([*keys, *(f'{t.sql} AS {n}' for n, t in q.items)])} FROM {source}{condition}"
    return f"SELECT {', '.join([*keys, *(f'{_listed(t, order)} AS {n}' for n, t in q.items)])} FROM {source}{condition} GROUP BY {groups}"


def to_pyspark(text: str, order: str = "timestamp, seq") -> str:
    """PySpark text that does the same, for those who leave q: a chain of DataFrame calls, or the dialect for joins."""
    if joined := _join(text):
        return f"dialect.sql(spark, {joined!r})"
    q = parse(text, order)
    if q.fby or q.verb in ("update", "delete") or not re.fullmatch(r"\w+", q.source) or not q.items or any(t.sql.startswith("ema(") for _, t in q.items):
        return f"dialect.sql(spark, {translate(text, order)!r})"
    out = [f"spark.table({q.source!r})"] + [f".where({dialect.rewrite(t.sql, order)!r})" for t in q.where]
    value = lambda sql, n: f"F.expr({dialect.rewrite(sql, order)!r}).alias({n!r})"
    keys, window = [value(t.sql, n) for n, t in q.by], any(t.kind == "window" for _, t in q.items)
    if q.by and not window:
        return "".join([*out, f".groupBy({', '.join(keys)})", f".agg({', '.join(value(_listed(t, order), n) for n, t in q.items)})"])
    if any(t.kind == "agg" for _, t in q.items):
        return "".join([*out, f".agg({', '.join(value(t.sql, n) for n, t in q.items)})"])
    distinct = [t for _, t in q.items if t.sql.startswith("DISTINCT ")]
    return "".join([*out, f".select({', '.join([*keys, *(value(t.sql.removeprefix('DISTINCT '), n) for n, t in q.items)])})", ".distinct()" if distinct else ""])


def run(spark: SparkSession, text: str, order: str = "timestamp, seq") -> DataFrame:
    """Runs a q query over the session's tables and views."""
    columns = None
    if not _join(text) and (q := parse(text, order)).verb == "update":
        columns = spark.sql(f"SELECT * FROM {q.source}").columns
    return dialect.sql(spark, translate(text, order, columns), order)
