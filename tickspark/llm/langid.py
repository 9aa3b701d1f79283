"""Operator 8. Language by word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls back to its
character n-grams, 5 down to 1 long, word ends marked: the longest length with a known n-gram scores
it, at a discount per step. A text's score is the posterior of the best language: its mean log score
per word times the evidence of its words, which grows ever more slowly with their number, since words
of a text aren't independent.

The model is fitted on a bounded sample of labelled rows, about SAMPLE a language, taken by a hash
(so that it neither follows ids nor file order), and holds at most WORDS words and GRAMS n-grams of
each length a language: it is the same few MB at every input size, and is sent to executors as such.
Scoring works on a block of texts at a time: distinct runs without white space are cut into words and
scored once, by 64-bit hashes of words and n-grams, and a text sums the scores of its runs.

Cases: a null text or one without a letter is `und` with score 0; letters of which the model knows
nothing (another script) leave all languages equally likely, which pipelines should reject; a
language without labelled rows is never predicted; without any labelled row everything is `und`; ties
go to the first language in alphabetical order; rows are judged each for itself, repeated or not; an
empty table gives no rows; a very long text is judged by all its words, though the fit passes over
texts of more than SAMPLE_CHARS. Only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.llm.common import in_blocks, is_held_out, text_of

SAMPLE, WORDS, GRAMS, LONGEST = 1500, 60_000, 12_000, 5
#: Longest text that the fit's sample takes, which bounds what the driver gathers.
SAMPLE_CHARS = 20_000
#: A step down in n-gram length costs this much, in nats, for every language alike.
STEP = 0.7
#: n words count as n * EVIDENCE / (n + EVIDENCE).
EVIDENCE = 20.0
UNKNOWN = "und"
#: Bytes of texts that are scored at once.
BLOCK_BYTES = 2_000_000
_word = re.compile(r"[^\W\d_]+")
_base = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    return _word.findall(text.lower())


def sample(docs: DataFrame, per_language: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """lang and text of about per_language rows a language, whole texts of SAMPLE_CHARS at most: rows whose hash lies in a slice of the range that shrinks as a language's rows grow."""
    rows = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) <= SAMPLE_CHARS) & ~is_held_out(id_col)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h"))
    slices = [(r.lang, per_language / r.n) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()]  # a row per language
    within = F.lit(False)
    for lang, share in slices:
        within = within | ((F.col("lang") == lang) & (F.expr("(h + 9223372036854775807D) / 18446744073709551614D") <= F.lit(share)))
    return rows.where(within).select("lang", "text")


def fit(docs: DataFrame, per_language: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """The languages, and by kind (0: words, n: n-grams) their keys and a row of log frequencies for each."""
    words: dict[str, Counter] = {}
    for row in sample(docs, per_language, id_col, text_col, lang_col).toLocalIterator():
        words.setdefault(row.lang, Counter()).update(words_of(row.text))
    langs = sorted(words)
    seen = [Counter({w: n for w, n in words[lang].items() if n >= 2}) for lang in langs]
    keys = sorted({k for c in seen for k, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:WORDS]})
    tables = {0: (keys, _logs(np.array([[c[k] for c in seen] for k in keys]), [sum(c.values()) for c in seen], len(langs)))}
    for n in range(1, LONGEST + 1):
        counted = [_gram_counts(words[lang], n) for lang in langs]
        named = {}
        for hashes, totals, at, text in counted:
            for i in np.lexsort((hashes, -totals))[:GRAMS].tolist():
                named[int(hashes[i])] = text[at[i] : at[i] + n]
        wanted = sorted(named, key=named.get)
        counts = np.zeros((len(wanted), len(langs)))
        for k, (hashes, totals, _, _) in enumerate(counted):
            row = _rows((hashes, totals), np.array(wanted, np.uint64))
            counts[:, k] = np.where(row >= 0, totals[row] if len(totals) else 0, 0)
        tables[n] = ([named[h] for h in wanted], _logs(counts, [c[1].sum() for c in counted], len(langs)))
    return {"langs": langs, "tables": tables}


def _logs(counts: np.ndarray, totals: list[float], k: int) -> np.ndarray:
    """Log frequencies, half a count added to each."""
    counts = counts.reshape(-1, k) if counts.size else np.zeros((0, k))
    return np.log((counts + 0.5) / (np.array(totals) + 0.5 * len(counts) + 1))


def _windows(words: list[str], n: int) -> tuple[str, np.ndarray, np.ndarray]:
    """The words with a mark, a space, around each; the places of their windows of n characters, and whose they are. Single characters are letters alone."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(lengths + 1) - lengths  # of each word's letters
    start, count = (first, lengths) if n == 1 else (first - 1, np.maximum(lengths + 3 - n, 0))
    owner = np.repeat(np.arange(len(words)), count)
    return " " + " ".join(words) + " ", np.repeat(start - (np.cumsum(count) - count), count) + np.arange(len(owner)), owner


def _gram_counts(words: Counter, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
    """Hashes of the words' n-grams, how often each is there, and a place of it in the text that comes last."""
    text, at, owner = _windows(list(words), n)
    hashes, first, back = np.unique(_hashes(_codes(text), n)[at], return_index=True, return_inverse=True)
    return hashes, np.bincount(back, np.fromiter(words.values(), float, len(words))[owner], len(hashes)), at[first], text


def _hashes(text: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n characters from each place on."""
    h = np.zeros(max(0, len(text) - n + 1), np.uint64)
    for k in range(n):
        h = (h + text[k : k + len(h)] + np.uint64(1)) * _base
        h ^= h >> np.uint64(29)
    return h


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _word_hashes(words: list[str]) -> np.ndarray:
    """Of words of any length: those of a length are hashed together."""
    out, lengths = np.zeros(len(words), np.uint64), np.fromiter(map(len, words), np.int64, len(words))
    text = _codes("".join(words))
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    cuts = [*np.flatnonzero(np.diff(lengths[order], prepend=-1)).tolist(), len(order)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        some, n = order[a:b], int(lengths[order[a]])
        h = np.full(len(some), n, np.uint64)
        for k in range(n):
            h = (h + text[starts[some] + k]) * _base
            h ^= h >> np.uint64(29)
        out[some] = h
    return out


def compiled(model: dict) -> dict:
    """The model with hashes, in rising order, for keys."""
    out = {}
    for kind, (keys, rows) in model["tables"].items():
        h = _word_hashes(keys) if kind == 0 else np.array([_hashes(_codes(k), kind)[0] for k in keys], np.uint64)
        order = np.argsort(h)
        out[kind] = (h[order], rows[order])
    return {"langs": model["langs"], "tables": out, "longest": max(map(len, model["tables"][0][0]), default=0)}


def _rows(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """The table's row of each hash, -1 where it lacks one."""
    known = table[0]
    if not len(known):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, -1)


def score_words(model: dict, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each word in lower case, its log scores by language, and whether the model knows anything of it."""
    tables = model["tables"]
    scores, done = np.zeros((len(words), len(model["langs"]))), np.zeros(len(words), bool)
    some = [i for i, w in enumerate(words) if len(w) <= model["longest"]]  # longer ones aren't known
    at = _rows(tables[0], _word_hashes([words[i] for i in some]))
    some = np.array(some, np.int64)[at >= 0]
    done[some] = True
    scores[some] = tables[0][1][at[at >= 0]]
    for n in range(LONGEST, 0, -1):
        left = np.flatnonzero(~done)
        if not len(left):
            break
        text, places, owner = _windows([words[i] for i in left.tolist()], n)
        at = _rows(tables[n], _hashes(_codes(text), n)[places])
        owner, at = owner[at >= 0], at[at >= 0]
        if len(at):
            heads = np.flatnonzero(np.diff(owner, prepend=-1))
            hits = np.diff(heads, append=len(owner))
            which = left[owner[heads]]
            scores[which] = np.add.reduceat(tables[n][1][at], heads, axis=0) / hits[:, None] - STEP * (LONGEST - n)
            done[which] = True
    return scores, done


def predict(model: dict, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, the place of its language (-1: none) and the score; model: compiled."""
    k = len(model["langs"])
    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    runs = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, offsets = runs.flatten(), runs.offsets.to_numpy().astype(np.int64)
    if not k or not len(flat):
        return best, score
    coded = flat.dictionary_encode()
    found = [_word.findall(x.lower()) for x in coded.dictionary.to_pylist()]
    words = [w for x in found for w in x]
    # a run's sums over its words; the last column counts those that the model knows, the one before it all
    scores, known = score_words(model, words)
    distinct = np.repeat(np.arange(len(found)), np.fromiter(map(len, found), np.int64, len(found)))
    slot = coded.indices.to_numpy()
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    each = lambda v: np.bincount(owner, np.bincount(distinct, v, len(found))[slot], len(texts))
    n, letters = each(known.astype(float)), each(np.ones(len(words)))
    total = np.stack([each(scores[:, i]) for i in range(k)], 1) / np.maximum(n, 1)[:, None]
    some = letters > 0
    total = np.round(total * (n * EVIDENCE / (n + EVIDENCE))[:, None], 9)  # ties stay ties, whatever a block sums first
    best[some] = total.argmax(1)[some]
    score[some] = (1 / np.exp(total - total.max(1, keepdims=True)).sum(1))[some]
    return best, np.round(score, 9)


def _named(langs: list[str], best: np.ndarray) -> pa.Array:
    return pa.array([*langs, UNKNOWN], pa.string()).take(pa.array(np.where(best < 0, len(langs), best)))


def predictor(spark: SparkSession, model: dict) -> Column:
    """A function of a text column that gives (lang_pred, score)."""
    sent, langs = spark.sparkContext.broadcast(compiled(model)), model["langs"]  # bounded by WORDS and GRAMS

    @F.arrow_udf("lang_pred string, score double")
    def run(texts: pa.Array) -> pa.Array:
        names, scores = [pa.array([], pa.string())], [pa.array([], pa.float64())]
        for block in in_blocks(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), "text", BLOCK_BYTES):
            best, score = predict(sent.value, block.column("text"))
            names.append(_named(langs, best))
            scores.append(pa.array(score))
        return pa.StructArray.from_arrays([pa.concat_arrays(names), pa.concat_arrays(scores)], names=["lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    sent, names = docs.sparkSession.sparkContext.broadcast(compiled(model)), model["langs"]  # bounded by WORDS and GRAMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in in_blocks(batches, "text", BLOCK_BYTES):
            best, score = predict(sent.value, block.column("text"))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("held_out"), _named(names, best), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(id_col).alias("held_out"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: dict, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, columns as they are, whose language is known with at least that score."""
    return docs.where(predictor(docs.sparkSession, model)(text_of(text_col))["score"] >= least)
