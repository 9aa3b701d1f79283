"""Operator 7. Toxicity: boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a learned lexicon (whole words, and word starts of 4 and 5
characters, which reach inflected and compounded forms), hits near a second-person pronoun, share of
capitals, punctuation and obfuscation (words that mix letters with digits or signs, or stretch a
letter). The lexicon comes from log odds over the fit rows; the trees are fitted to log loss by
second-order boosting over binned features; a third of the fit rows, kept from the trees and the
lexicon, calibrates their scores by pooling adjacent violators.

The fit gathers about SAMPLE labelled rows of SAMPLE_CHARS at most, half of them toxic where there
are as many, chosen by a hash of the id; its classes are weighted back to their share. It is the same size at every input.

Cases: a null or empty text scores as a text without words; without labelled rows of both classes
every score is the share of toxic rows, or 0; a doc_id with several labels counts as toxic if one
is; repeated rows are scored each.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import is_held_out, text_of

SAMPLE, SAMPLE_CHARS = 12_000, 20_000
LEXICON, LEAST_DF = 4000, 3
TREES, DEPTH, BINS, RATE = 60, 3, 32, 0.2
#: Second-person pronouns of the languages served.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen tu te toi ton ta tes vous votre vos usted ustedes tú ti tuyo contigo".split())
NEAR = 4
#: Words of a peak.
SPAN = 40
_word = re.compile(r"\S+")
_letters = re.compile(r"[^\W\d_]+")
_capitals = re.compile("[A-ZÀ-ÖØ-Þ]")
_signs = re.compile(r"[\d@$*#%&|]")
_stretched = re.compile(r"([^\W\d_])\1\1")
_mixed = re.compile(r"[^\W\d_][\d@$!*#%&|]+[^\W\d_]|[\d@$*#%&|]+[^\W\d_]{2}")


def keys_of(word: str) -> tuple[str, ...]:
    """What the lexicon may hold of a lower-case word: itself and its starts."""
    return (word, f"{word[:4]}~", f"{word[:5]}~") if len(word) > 5 else (word, f"{word[:4]}~") if len(word) > 4 else (word,)


def learn_lexicon(texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> dict[str, float]:
    """Words and starts by log odds of toxicity, over document frequency."""
    df = (Counter(), Counter())
    for text, y in zip(texts, toxic, strict=True):
        df[y].update({k for w in set(_letters.findall(text.lower())) for k in keys_of(w)})
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    odds = {k: math.log((c + 0.5) / (n1 + 1)) - math.log((df[0][k] + 0.5) / (n0 + 1)) for k, c in df[1].items() if c >= LEAST_DF}
    worth = sorted(((o * math.sqrt(df[1][k]), k) for k, o in odds.items() if o > 1.5), reverse=True)[:LEXICON]
    return {k: odds[k] for _, k in worth}


FEATURES = ("word_density", "start_density", "best_odds", "odds_density", "peak_hits", "peak_odds", "near_second", "second_density", "capitals", "shouted", "punctuation", "exclaims", "obfuscated", "stretched", "log_words", "mean_length")


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """FEATURES of a text. Densities are per word; peaks are those of the densest SPAN words, so that a long clean text hides nothing."""
    raw = _word.findall(text)
    words = _letters.findall(text.lower())
    n = max(1, len(words))
    get = lexicon.get
    hits, odds_of, whole = [], [], 0
    for i, w in enumerate(words):
        odds = get(w)
        if odds is not None:
            whole += 1
        elif len(w) > 4:
            odds = get(w[:5] + "~") if len(w) > 5 else None
            if odds is None:
                odds = get(w[:4] + "~")
        if odds is not None:
            hits.append(i)
            odds_of.append(odds)
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    peak, peak_odds, near = 0, 0.0, 0
    if hits:
        at, sums = np.array(hits), np.concatenate(([0.0], np.cumsum(odds_of)))
        ends = np.searchsorted(at, at + SPAN)  # hits of the SPAN words from each hit on
        peak, peak_odds = int((ends - np.arange(len(at))).max()), float((sums[ends] - sums[:-1]).max())
        if you:
            other = np.array(you)
            right = np.searchsorted(other, at)
            gap = np.minimum(np.abs(other[np.minimum(right, len(other) - 1)] - at), np.abs(other[np.maximum(right - 1, 0)] - at))
            near = int((gap <= NEAR).sum())
    chars = max(1, len(text))
    letters = max(1, sum(map(len, words)))
    return [
        whole / n, (len(hits) - whole) / n, max(odds_of, default=0.0), sum(odds_of) / n, peak / SPAN, peak_odds / SPAN, near / max(1, len(hits)), len(you) / n,
        len(_capitals.findall(text)) / letters,
        sum(1 for w in raw if len(w) > 2 and w.isupper()) / max(1, len(raw)),
        (chars - letters - len(raw)) / chars, text.count("!") / chars,
        len(_mixed.findall(text)) / n if _signs.search(text) else 0.0, len(_stretched.findall(text)) / n, math.log1p(len(words)), letters / n,
    ]


def fit_trees(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict:
    """Second-order boosting of complete trees of DEPTH levels over quantile bins."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    base = float(np.clip(np.average(y, weights=w), 1e-4, 1 - 1e-4))
    score, trees = np.full(len(y), math.log(base / (1 - base))), []
    start = float(score[0])
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = w * (p - y), w * p * (1 - p)
        leaf, splits = np.zeros(len(y), np.int64), []
        for level in range(DEPTH):
            n, at = 1 << level, []
            gains = np.full(n, 1e-9)
            pick = [(0, np.inf)] * n
            for j, e in enumerate(edges):
                size = len(e) + 1
                place = leaf * size + binned[:, j]
                gs = np.bincount(place, g, n * size).reshape(n, size).cumsum(1)
                hs = np.bincount(place, h, n * size).reshape(n, size).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain = gain[:, :-1]
                if gain.shape[1]:
                    k = gain.argmax(1)
                    for node in range(n):
                        if gain[node, k[node]] > gains[node]:
                            gains[node], pick[node] = gain[node, k[node]], (j, float(e[k[node]]))
            at = pick
            splits.append(at)
            feature, cut = np.array([a for a, _ in at])[leaf], np.array([b for _, b in at])[leaf]
            leaf = 2 * leaf + (x[np.arange(len(x)), feature] > cut)
        n = 1 << DEPTH
        gs, hs = np.bincount(leaf, g, n), np.bincount(leaf, h, n)
        value = -RATE * gs / (hs + 1)
        trees.append((splits, value))
        score = score + value[leaf]
    return {"start": start, "trees": trees}


def raw_scores(model: dict, x: np.ndarray) -> np.ndarray:
    score, rows = np.full(len(x), model["start"]), np.arange(len(x))
    for splits, value in model["trees"]:
        leaf = np.zeros(len(x), np.int64)
        for at in splits:
            feature, cut = np.array([a for a, _ in at])[leaf], np.array([b for _, b in at])[leaf]
            leaf = 2 * leaf + (x[rows, feature] > cut)
        score = score + value[leaf]
    return score


def isotonic(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators: rising scores and their calibrated values."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, t, u in zip(score[order], y[order], w[order], strict=True):
        blocks.append([s, s, t * u, u])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    at, value = [], []
    for lo, hi, t, u in blocks:
        mean = (t + 0.02) / (u + 0.2)  # a little prior keeps scores off 0 and 1
        at += [lo, hi] if hi > lo else [lo]
        value += [mean, mean] if hi > lo else [mean]
    return np.array(at), np.maximum.accumulate(np.array(value))


def calibrated(model: dict, x: np.ndarray) -> np.ndarray:
    raw = raw_scores(model, x)
    at, value = model["isotonic"]
    # a slight share of the raw score orders the texts of one step
    return np.clip(0.999 * np.interp(raw, at, value) + 0.001 / (1 + np.exp(-raw)), 0, 1)


def fit_rows(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str) -> tuple[pd.DataFrame, dict[int, int]]:
    """The bounded sample, and all labelled fit rows by class."""
    labelled = labels.where(F.col("toxic").isNotNull() & ~is_held_out("doc_id")).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    labelled = labelled.withColumn("h", F.xxhash64("doc_id", F.lit(7)))
    counts = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # hashes are even, so a slice of their range holds about half the sample of each class, at any size
    within = F.lit(False)
    for y, n in sorted(counts.items()):
        within = within | ((F.col("toxic") == y) & (F.expr("(h + 9223372036854775807D) / 18446744073709551614D") <= F.lit(min(1.0, sample / 2 / n))))
    chosen = F.broadcast(labelled.where(within).select("doc_id", "toxic", "h"))  # about SAMPLE rows
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    rows = texts.join(chosen, "doc_id").select("toxic", "h", "text").toPandas()
    return rows.sort_values(["h", "text"]).drop_duplicates(["h"]).reset_index(drop=True), counts


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> dict:
    rows, counts = fit_rows(docs, labels, sample, id_col, text_col)
    y = rows["toxic"].to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64)
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(set(y)) < 2:
        return {"lexicon": {}, "constant": share}
    w = np.where(y == 1, counts[1] / y.sum(), counts[0] / (1 - y).sum())
    w = w / w.mean()
    texts = rows["text"].tolist()
    third = np.arange(len(y)) % 3
    # features of a row come from a lexicon that other rows made, so that trees see honest hits
    x = np.zeros((len(y), len(FEATURES)))
    for fold in (0, 1):
        other = np.flatnonzero(third == 1 - fold)
        lexicon = learn_lexicon([texts[i] for i in other], y[other], w[other])
        for i in np.flatnonzero(third == fold):
            x[i] = features(texts[i], lexicon)
    used = np.flatnonzero(third < 2)
    lexicon = learn_lexicon([texts[i] for i in used], y[used], w[used])
    model = fit_trees(x[used], y[used], w[used])
    rest = np.flatnonzero(third == 2)
    xs = np.array([features(texts[i], lexicon) for i in rest])
    model["isotonic"] = isotonic(raw_scores(model, xs), y[rest], w[rest])
    return model | {"lexicon": lexicon}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by LEXICON and TREES

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        own = sent.value
        if "constant" in own:
            return pd.Series(np.full(len(texts), own["constant"]))
        return pd.Series(calibrated(own, np.array([features(t, own["lexicon"]) for t in texts]))) if len(texts) else pd.Series([], dtype=float)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(id_col).alias("held_out"), run(text_of(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
