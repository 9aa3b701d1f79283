"""Operator 5. Secrets: Aho-Corasick keyword prefilter, anchored expressions near hits, checksums.

One automaton finds the literal starts of all keyed kinds in an ASCII-lowered text; each kind's
expression is then matched at its hits alone, never searched. Runs of hexadecimal digits have no
literal start and are found by their own scan. Kinds beside the three base ones are reported only if
a checksum or structure inside them holds:
  github  gh[pousr]_ and npm npm_: 30 base-62 characters and 6 that encode their crc32
  jwt     three base64url parts whose first two decode to JSON objects, the first with "alg"

Base spans are leftmost and non-overlapping per kind, a match that is too short still consuming its
characters; added spans never remove them. Cases: a null or empty text has no spans; repeated rows
are scanned each; an empty table gives no rows; a very long text is scanned whole, and one whose JSON
is nested beyond the parser's depth has no jwt span. Only the id and text columns are read.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import in_blocks, text_of

BASE = ("assign", "access", "hex")
#: In the order in which spans of one start are listed.
KINDS = (*BASE, "github", "npm", "jwt")
_letters = {c: f"[{c.upper()}{c}]" for c in "abcdefghijklmnopqrstuvwxyz"}


def _either_case(word: str) -> str:
    return "".join(_letters.get(c, c) for c in word)


_assign = re.compile("(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_access = re.compile("AKIA[A-Z0-9]+")
_hex = re.compile("[0-9a-f]{24,}")
_github = re.compile("gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
_npm = re.compile("npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
_jwt = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
_digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Literal starts by kind, lowered.
STARTS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",), "jwt": ("eyj",)}
_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_automaton = None


def base62_crc32(body: str) -> str:
    """crc32 of body as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _digits[d] + out
    return out


def _checked(m: re.Match) -> bool:
    return base62_crc32(m[1][:30]) == m[1][30:]


def _part(x: str) -> object:
    try:
        return json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4)))
    except (ValueError, RecursionError):  # no JSON, or nested deeper than the parser goes: no token has that
        return None


def _signed(m: re.Match) -> bool:
    head, body, _ = m[0].split(".")
    head = _part(head)
    return isinstance(head, dict) and "alg" in head and isinstance(_part(body), dict)


RULES = {
    "assign": (_assign, lambda m: len(m[2]) >= 6),
    "access": (_access, lambda m: len(m[0]) >= 20),
    "github": (_github, _checked),
    "npm": (_npm, _checked),
    "jwt": (_jwt, _signed),
}


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for kind, words in STARTS.items():
            for word in words:
                _automaton.add_word(word, (kind, len(word)))
        _automaton.make_automaton()
    return _automaton


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind as in KINDS."""
    if not text:
        return []
    found = [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    hits: dict[str, list[int]] = {}
    for end, (kind, n) in automaton().iter(text.translate(_lower) if not text.isascii() else text.lower()):
        hits.setdefault(kind, []).append(end - n + 1)
    for kind, starts in hits.items():
        (rule, holds), done, k = RULES[kind], 0, KINDS.index(kind)
        for start in sorted(starts):
            if start >= done and (m := rule.match(text, start)):
                done = m.end()
                if holds(m):
                    found.append((start, k, done))
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for block in in_blocks(batches, "text"):
        out = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t)] for t in block.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: array of (kind, start, end)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(_scan, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")
