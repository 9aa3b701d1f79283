"""Exact tokenization through the tokenizers library, each distinct word of a block encoded once.

Texts are cut at ASCII white space in Arrow, words become numbers there, and only distinct words that
the worker's cache lacks go through the library; ids are then gathered by number. No token of these
tokenizers reaches over such a cut: their pre-tokenizers match at most one leading space and then
letters, digits or other signs, and their normalizers join nothing over a space. Texts for which that
may not hold (other white space, white space in a row where it counts, strings of special tokens) go
through the library whole.
"""

from __future__ import annotations

import codecs
import hashlib
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tickspark.llm.common import trim

#: Bytes of words and ids that a Python worker's cache may hold before it is cut back to those of the current block.
CACHE_BYTES = 12_000_000
#: Bytes that a cached word takes beside its own and its ids: its place and size.
ENTRY = 12
#: Longer words (texts without spaces are one word) never enter the cache.
LONGEST = 64
#: Bytes of texts that callers should encode at once.
BLOCK_BYTES = 4_000_000
#: Characters that go through the library at once: its result holds a hundred bytes a token beside ids.
SLICE = 200_000
#: White space outside ASCII, separators that only some libraries call space, the letter whose lower case
#: is more than a letter, and special tokens.
WHOLE = r"[\x{130}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]|<\|"
#: Besides, where spaces count: a space beside white space or at an end.
WHOLE_SPACED = WHOLE + r"|\x20[\x09-\x0D\x20]|[\x09-\x0D]\x20|\A\x20|\x20\z"

#: Classes of a byte where texts are cut into words; the apostrophe, control characters and what isn't ASCII are in none.
BLANK, LETTER, DIGIT, SIGN, NONE = range(5)
BLANKS = b" \t\n\v\f\r"
KINDS = bytes(BLANK if c in BLANKS else NONE if c > 126 or c < 33 or c == 39 else LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else SIGN for c in range(256))
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: By the classes of two bytes, 5 * first + second: 1 if the second starts a word, 2 if it does after a letter.
STARTS = bytes(0 if b == BLANK or a == b else 1 if a == BLANK or NONE not in (a, b) else 2 if a == NONE and b in (DIGIT, SIGN) else 0 for a in range(5) for b in range(5)) + bytes(231)
#: Letters of two or three UTF-8 bytes, by code point, that any library knows, those of Unicode 3.2; but for letters that normalizing takes apart into a letter and a mark.
LETTERS = np.array([c > 127 and unicodedata.ucd_3_2_0.category(chr(c))[0] == "L" and all(unicodedata.category(x)[0] == "L" for x in unicodedata.normalize("NFC", chr(c))) for c in range(1 << 16)])
#: Lower-case letters that normalizing leaves as they are, alone and side by side: none of them combines.
_lower = re.compile("[a-z" + "".join(c for c in map(chr, range(128, 0x530)) if unicodedata.ucd_3_2_0.category(c) == "Ll" and c.lower() == c and unicodedata.normalize("NFC", c) == c) + "]+").fullmatch
#: The byte-level pre-tokenizer's character of each byte; the space stays one.
_printed = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
_others = [c for c in range(256) if c not in _printed]
BYTE_CHARS = "".join(" " if c == 32 else chr(c if c in _printed else 256 + _others.index(c)) for c in range(256))

_pieces = re.compile(r"[^\W\d_]+|[0-9]|[!-&(-/:-@\[-`{-~]+").findall
_encoders: dict[tuple[str, bool], Encoder] = {}


class Encoder:
    """drops_space: the tokenizer ignores white space and case (word_bpe); else a word takes the space before it (byte_bpe)."""

    def __init__(self, path: str, drops_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.drops_space = drops_space
        self.usual = (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)
        self.at_spaces = pre_tokenizers.WhitespaceSplit()
        # ids that end a word of letters, or that start one after a space
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        self.edge[[i for t, i in vocabulary.items() if (t.endswith("</w>") if drops_space else t.startswith("Ġ"))]] = True
        self.words = pa.array([], pa.string())
        self.sizes, self.pool = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.uses = np.zeros(0, np.int32)  # blocks that held a word

    def cached_bytes(self) -> int:
        return cost(self.words, self.sizes)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and joined ids of texts."""
        sizes, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for a, b in slices(texts):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts[a:b], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            parts.append(np.array([x for y in ids for x in y], np.uint32))
        return np.concatenate(sizes), np.concatenate(parts)

    def _plain(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Words of small letters alone: normalizing and cutting leave them as they are, so the model gets their bytes' characters cut at spaces."""
        if self.usual[0] is not None:
            self.tokenizer.normalizer = None
        self.tokenizer.pre_tokenizer = self.at_spaces
        try:
            return [self._joined(self._shown(words[a:b]), words[a:b], np.ones(b - a, np.int64)) for a, b in slices(words)]
        finally:
            if self.usual[0] is not None:
                self.tokenizer.normalizer = self.usual[0]
            self.tokenizer.pre_tokenizer = self.usual[1]

    def _shown(self, words: list[str]) -> str:
        """The words as the byte-level pre-tokenizer would show them to the model, with a space between any two."""
        text = codecs.charmap_decode(" ".join(words).encode(), "strict", BYTE_CHARS)[0]
        return text if self.drops_space else "Ġ" + text.replace(" ", " Ġ")

    def _sure(self, words: list[str], pieces: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [self._joined(" ".join(words[a:b]) if self.drops_space else "".join(f" {w}" for w in words[a:b]), words[a:b], pieces[a:b]) for a, b in slices(words)]

    def _joined(self, text: str, words: list[str], pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words encoded as one text that is cut where its ids say; one by one if that doesn't give as many."""
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(self.edge[ids])
        if self.drops_space and len(at) == pieces.sum():
            return np.diff(at[np.cumsum(pieces) - 1] + 1, prepend=0), ids
        if not self.drops_space and len(at) == len(words):
            return np.diff(at, append=len(ids)), ids
        return self._library([w if self.drops_space else f" {w}" for w in words])

    def _coded(self, words: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The words in another order, with sizes and ids: one text of all that are sure to end where their ids say, which are words of known pieces, or any word after a space."""
        plain, others = [], []
        for w in words:
            (plain if w.isalpha() and (w.islower() if w.isascii() else self.drops_space and _lower(w)) else others).append(w)
        if self.drops_space:
            pieces = [1 if w.isalpha() else pieces_of(w) for w in others]
            sure, rest = [w for w, k in zip(others, pieces, strict=True) if k], [w for w, k in zip(others, pieces, strict=True) if not k]
            pieces = [k for k in pieces if k]
        else:
            sure, rest = [w for w in others if w], [w for w in others if not w]
            pieces = [1] * len(sure)
        parts = [*self._plain(plain), *self._sure(sure, np.array(pieces, np.int64)), self._library(rest)]
        return pa.array([*plain, *sure, *rest], pa.string()), np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])

    def _table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The slot of every word, and the sizes and joined ids of all slots: those of the cache, then what it lacked."""
        coded = words.dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=self.words)
        known, lacks = len(self.words), pc.is_null(found)
        slots = pc.fill_null(found, 0).to_numpy().copy()
        sizes, ids = self.sizes, self.pool
        if found.null_count:
            others = coded.dictionary.filter(lacks)
            new, more, their = self._coded(others.to_numpy(zero_copy_only=False).tolist())
            slots[np.flatnonzero(lacks.to_numpy(zero_copy_only=False))] = pc.index_in(others, value_set=new).to_numpy() + known
            sizes, ids = np.concatenate([sizes, more]), np.concatenate([ids, their])
        used = np.zeros(len(sizes), bool)
        used[slots] = True
        self.uses += used[:known]
        if found.null_count:
            self._remember(new, sizes, ids)
        return slots[coded.indices.to_numpy()], sizes, ids

    def _remember(self, new: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        """The cache with the new words of usual length; beyond its bytes it falls back to half of them, and to the words that most blocks held."""
        known = len(self.words)
        usual = np.flatnonzero(pc.less_equal(pc.binary_length(new), LONGEST).to_numpy(zero_copy_only=False))
        keep = np.concatenate([np.arange(known), known + usual])
        words = pa.concat_arrays([self.words, new]).take(pa.array(keep))
        uses = np.concatenate([self.uses, np.ones(len(usual), np.int32)])
        if cost(words, sizes[keep]) > CACHE_BYTES:
            order = np.argsort(-uses, kind="stable")
            costs = pc.binary_length(words).to_numpy() + 4 * sizes[keep] + ENTRY
            stay = np.sort(order[np.cumsum(costs[order]) <= CACHE_BYTES // 2])
            keep, words, uses = keep[stay], words.take(pa.array(stay)), uses[stay]
        self.words, self.pool, self.sizes, self.uses = words, gather(ids, np.cumsum(sizes) - sizes, sizes, keep), sizes[keep], uses

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids in order. Null is empty."""
        return self._run(texts, True)

    def count(self, texts: pa.Array) -> np.ndarray:
        return self._run(texts, False)[0]

    def _run(self, texts: pa.Array, with_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        texts = pc.fill_null(texts, "")
        odd = np.flatnonzero(pc.match_substring_regex(texts, WHOLE if self.drops_space else WHOLE_SPACED).to_numpy(zero_copy_only=False))
        plain = texts
        if len(odd):
            plain = pc.replace_with_mask(texts, pa.array(np.isin(np.arange(len(texts)), odd)), pa.scalar("", texts.type))
        if self.drops_space:
            flat, offsets = words_of(plain)
        else:
            words = pc.split_pattern(plain, " ")
            offsets = words.offsets.to_numpy().astype(np.int64)
            flat, offsets = words.flatten(), offsets - offsets[0]
        slots, sizes, pool = self._table(flat)
        if not self.drops_space and len(slots):
            # a text's first word has no space before it
            firsts = offsets[:-1]
            heads = flat.take(pa.array(firsts)).dictionary_encode()
            more, ids = self._library(heads.dictionary.to_pylist())
            slots[firsts] = len(sizes) + heads.indices.to_numpy()
            sizes, pool = np.concatenate([sizes, more]), np.concatenate([pool, ids])
        ends = np.concatenate(([0], np.cumsum(sizes[slots])))
        n = ends[offsets[1:]] - ends[offsets[:-1]]
        whole = self._library(texts.take(pa.array(odd)).to_pylist()) if len(odd) else None
        if not with_ids:
            if whole:
                n[odd] = whole[0]
            return n, None
        ids = gather(pool, np.cumsum(sizes) - sizes, sizes, slots)
        if whole:
            parts, at, more = [], 0, np.split(whole[1], np.cumsum(whole[0])[:-1])
            for i, x in zip(odd.tolist(), more, strict=True):
                stop = int(ends[offsets[i]])
                parts += [ids[at:stop], x]
                at, n[i] = stop, len(x)
            ids = np.concatenate([*parts, ids[at:]])
        return n, ids


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts without nulls, A-Z lower-cased, and the number of words before each text and after the last.

    Words end at white space, and where letters, digits and signs meet: pre-tokens end there too, and
    fewer words are distinct so. A letter outside ASCII ends before signs and digits only.
    """
    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if bounds[0] == bounds[-1]:
        return pa.array([], pa.string()), np.zeros(len(bounds), np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds, raw = bounds - bounds[0], data.tobytes()
    kinds = np.frombuffer(raw.translate(KINDS), np.uint8)
    held = kinds != BLANK
    pairs = np.frombuffer((kinds[:-1] * np.uint8(5) + kinds[1:]).tobytes().translate(STARTS), np.uint8)
    starts = np.empty(len(data), bool)  # bytes that start a word
    starts[0], starts[1:] = held[0], pairs == 1
    at = np.flatnonzero(pairs == 2) + 1
    last, middle, first = (data[np.maximum(at - k, 0)].astype(np.int32) for k in (1, 2, 3))
    two, three = (last >= 0x80) & (middle >= 0xC0), (last >= 0x80) & (middle < 0xC0) & (first >> 4 == 0xE)
    code = np.where(two, (middle & 0x1F) << 6 | last & 0x3F, np.where(three, (first & 0xF) << 12 | (middle & 0x3F) << 6 | last & 0x3F, 0))
    starts[at[LETTERS[code]]] = True
    firsts = bounds[:-1][bounds[:-1] < len(data)]
    starts[firsts] = held[firsts]
    begin = np.flatnonzero(starts)
    # white space goes, so that words lie one after another
    kept = raw.translate(LOWER, BLANKS)
    words = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(np.append(np.flatnonzero(starts[held]), len(kept)).astype(np.int64)), pa.py_buffer(kept)])
    return words.cast(pa.string()), np.searchsorted(begin, bounds)


def cost(words: pa.Array, sizes: np.ndarray) -> int:
    """Bytes of words, their ids, places and sizes."""
    return int(pc.sum(pc.binary_length(words)).as_py() or 0) + 4 * int(sizes.sum()) + ENTRY * len(words)


def slices(texts: list[str]) -> list[tuple[int, int]]:
    """Runs of texts of SLICE characters or so; a longer text is a run of its own."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    out, start = [], 0
    while start < len(texts):
        before = int(ends[start - 1]) if start else 0
        stop = max(int(np.searchsorted(ends, before + SLICE + 1, side="right")), start + 1)
        out.append((start, stop))
        start = stop
    return out


def pieces_of(word: str) -> int:
    """How many pre-tokens a word of letters, ASCII digits and ASCII signs has; 0 if it holds others, or an apostrophe, whose pieces depend on what follows."""
    found = _pieces(word)
    return len(found) if sum(map(len, found)) == len(word) else 0


def gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The pool's runs of the given slots, one after another."""
    each = sizes[slots]
    ends = np.cumsum(each)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(n, len(pool)) < 1 << 31 else np.int64
    at = np.repeat((starts[slots] - (ends - each)).astype(kind), each)
    at += np.arange(n, dtype=kind)
    return pool[at]


def with_end(n: np.ndarray, ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id after each text's ids."""
    n = n + 1
    out = np.empty(len(ids) + len(n), "<u4")
    last = np.zeros(len(out), bool)
    last[np.cumsum(n) - 1] = True
    out[last], out[~last] = end_id, ids
    return n, out


def release() -> None:
    """Frees the encoders of this process: steps without a tokenizer call it, since Python workers are reused."""
    if _encoders:
        _encoders.clear()
        pa.default_memory_pool().release_unused()
        trim()


def encoder(path: str, drops_space: bool) -> Encoder:
    """The encoder of this process; Python workers are reused, so its cache outlives a task."""
    key = (path, drops_space)
    if key not in _encoders:
        _encoders[key] = Encoder(path, drops_space)
    return _encoders[key]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def version_digest(path: str) -> str:
    """Names the tokenizer by the bytes of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
