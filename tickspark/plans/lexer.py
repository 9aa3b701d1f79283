"""SQL text as tokens, so that rewriting never looks into comments, strings or quoted names."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*|`[^`]*`)"""
    r"""|(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?[A-Za-z]*)|(?P<sign><=>|<>|!=|<=|>=|\|\||::|.)""",
    re.S,
)
#: Words that end a chain of factors.
_ENDS = frozenset("select distinct from where and or not in is like between case when then else end as on by group order having limit join asof aj0 window union plus inner left right full outer using over partition rows range asc desc div".split())
#: Functions whose results aren't whole numbers.
_REAL = frozenset("avg vwap sqrt ln log log2 log10 exp pow power stddev stddev_pop stddev_samp var_pop var_samp variance median percentile double float decimal rand corr cume_dist percent_rank round".split())


class Token(NamedTuple):
    kind: str
    text: str

    def word(self) -> str:
        return self.text.lower() if self.kind == "name" else ""


def tokens(sql: str) -> list[Token]:
    """All tokens; a comment is a space."""
    out = []
    for m in _TOKEN.finditer(sql):
        text = m[0]
        out.append(Token(m.lastgroup or "sign", " " if m.lastgroup == "space" and text[:2] in ("--", "/*") else text))
    return out


def text_of(parts: list[Token]) -> str:
    return "".join(t.text for t in parts)


def without_comments(sql: str) -> str:
    return text_of(tokens(sql))


def closing(parts: list[Token], start: int) -> int:
    """The place of the parenthesis that closes the one at start."""
    depth = 0
    for i in range(start, len(parts)):
        depth += (parts[i].text == "(") - (parts[i].text == ")")
        if not depth:
            return i
    raise ValueError(f"no closing parenthesis: {text_of(parts[start : start + 12])}")


def _primary(parts: list[Token], i: int) -> int:
    """The end of the operand that starts at i: a sign, a name with its dots and call, a number, or parentheses."""
    while i < len(parts) and (parts[i].kind == "space" or parts[i].text in "+-"):
        i += 1
    if i >= len(parts):
        return i
    if parts[i].text == "(":
        return closing(parts, i) + 1
    i += 1
    while i + 1 < len(parts) and parts[i].text == ".":
        i += 2
    j = i
    while j < len(parts) and parts[j].kind == "space":
        j += 1
    return closing(parts, j) + 1 if j < len(parts) and parts[j].text == "(" and parts[i - 1].kind == "name" and parts[i - 1].word() not in _ENDS else i


def whole_division(parts: list[Token], is_real: Callable[[str], bool]) -> list[Token]:
    """a / b of whole numbers becomes division toward zero, 0 where b is 0. is_real: whether a name is a column of another kind."""

    def real(some: list[Token]) -> bool:
        return any(t.kind == "number" and re.search(r"[.eEdDfF]", t.text) or t.kind == "name" and (t.word() in _REAL or is_real(t.word())) for t in some)

    out: list[Token] = []
    chain, i = 0, 0  # where the factors before this place start in out
    while i < len(parts):
        t = parts[i]
        if t.text == "(":
            end = closing(parts, i)
            out += [t, *whole_division(parts[i + 1 : end], is_real), parts[end]]
            i = end + 1
            continue
        if t.text == "/":
            end = _primary(parts, i + 1)
            left, right = out[chain:], whole_division(parts[i + 1 : end], is_real)
            if real(left) or real(right):
                out += [t, *right]
            else:
                lead = [x for x in left[: next((k for k, x in enumerate(left) if x.kind != "space"), 0)]]
                r = text_of(right)
                out = [*out[:chain], *lead, Token("sign", f"(CASE WHEN ({r}) = 0 THEN 0L ELSE ({text_of(left[len(lead) :])}) div nullif(({r}), 0) END)")]
            i = end
            continue
        out.append(t)
        if t.kind == "sign" and t.text not in "*%." or t.word() in _ENDS:
            chain = len(out)
        i += 1
    return out
