"""Operator 3. Soft-membership mixing to target weights.

A domain is a combination of values of columns of the label table (quality and toxic, unless others
are named). A softmax classifier, fitted on about SAMPLE labelled rows, gives every document
posteriors over the domains: its features are the log odds of words for each label value, and shares
of signs, capitals and repeats. Document rates r >= 0 then minimise the squared gaps between expected
domain token totals sum(r * tokens * posterior) and the targets, each over its domain's natural total:
accelerated projected gradient steps from r = 1, in the metric of tokens, of a size that the largest
eigenvalue of the posteriors' Gram matrix gives. A step is one aggregation over all documents and one
vector over domains, so a document's rate follows from its posterior and the list of steps, and nothing
per document is kept between steps. They end when all targets are met, or when neither rates nor
squared gaps change any more (then some target is out of reach and the least squares are found), or
after STEPS, which is all that `converged` denies.

Targets are weights of a token budget, or multiples of the domains' natural expected totals. A rate
becomes a whole number of copies by adding a number in [0, 1) that the id's hash gives, and cutting.

Tokens are words, or the numbers in a column that the caller names (op4's counts, say). Cases: null
and empty texts have no words and get a rate like others; without labelled rows there is one domain,
which gets the whole budget; a domain without a weight keeps its natural share; repeated rows are
documents each, and rows in ties get equal rates; an empty table gives no rows; a domain that no
document may belong to can't be reached and keeps its gap; a very long text is read whole, though the
fit passes over texts of more than SAMPLE_CHARS. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import in_blocks, text_of, work_dir, written
from tickspark.llm.shingles import word_hashes

SAMPLE, SAMPLE_CHARS = 6000, 20_000
#: Words that speak for or against a label value: in so many documents of the fit, by such log odds.
LEAST_DF, LEAST_ODDS, STRONG = 3, 1.0, 2.0
#: Documents without a say that shrink a word's log odds.
SHRUNK = 6
#: Most steps, and how close totals and rates come, as a share of all tokens.
STEPS, CLOSE = 200, 1e-7
#: Steps that must lower the squared gaps by a millionth of them, or they are least.
STALL = 10
#: Columns of the label table whose values make the domains.
DOMAINS = ("quality", "toxic")
#: Shares of the budget: clean text of high quality above all.
WEIGHTS = {"quality=1,toxic=0": 0.88, "quality=1,toxic=1": 0.05, "quality=0,toxic=0": 0.06, "quality=0,toxic=1": 0.01}
#: The budget, as a multiple of all tokens.
BUDGET = 1.1

_symbol = np.isin(np.arange(256), list(b"#*$%&|<>"))
_upper = np.isin(np.arange(256), list(range(ord("A"), ord("Z") + 1)))
_point = np.isin(np.arange(256), list(b"!?.,;:"))


def read(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of the texts, their number in each, and dense features of each."""
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64))).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    words, upto = word_hashes(data, offsets)
    n = np.diff(np.concatenate(([0], upto)))
    owner = np.repeat(np.arange(len(texts)), n)
    size = np.maximum(np.diff(offsets), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        upto = np.concatenate(([0], np.cumsum(mask[data], dtype=np.int64)))
        return (upto[offsets[1:]] - upto[offsets[:-1]]) / size

    again = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    runs = np.bincount(owner[1:][again], minlength=len(texts)) if len(words) else np.zeros(len(texts))
    dense = np.stack([np.log1p(n) / 8, np.minimum(10 * share(_symbol), 3), np.minimum(5 * share(_upper), 3), np.minimum(5 * share(_point), 3), 3 * runs / np.maximum(n, 1), size / np.maximum(n, 1) / 20], 1)
    return words, n.astype(np.int64), np.minimum(dense, 5)


def evidence(table: tuple[np.ndarray, np.ndarray], words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each text, by label value: mean, highest and lowest log odds of its words, and the share of strong ones."""
    known, odds = table
    out = np.zeros((len(n), 4 * odds.shape[1]))
    if not len(known) or not len(words):
        return out
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    hit = np.flatnonzero(known[at] == words)
    owner = np.repeat(np.arange(len(n)), n)[hit]
    if not len(hit):
        return out
    heads = np.flatnonzero(np.diff(owner, prepend=-1))
    which = owner[heads]
    each = odds[at[hit]]
    size = np.maximum(n[which], 1)[:, None]
    out[which] = np.concatenate([np.add.reduceat(each, heads) / size, np.maximum(np.maximum.reduceat(each, heads), 0) / 4, np.minimum(np.minimum.reduceat(each, heads), 0) / 4, np.add.reduceat((each > STRONG).astype(float), heads) / np.sqrt(size)], 1)
    return out


def odds_table(words: np.ndarray, n: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of telling words in rising order, and their log odds for each column of marks (rows: texts, 0 or 1), by document frequency."""
    owner = np.repeat(np.arange(len(n)), n)
    keys, word = np.unique(words, return_inverse=True)
    pairs = np.unique(word * len(n) + owner) if len(words) else np.zeros(0, np.int64)
    word, owner = pairs // max(len(n), 1), pairs % max(len(n), 1)
    df = np.bincount(word, minlength=len(keys))
    odds = np.zeros((len(keys), marks.shape[1]))
    for v in range(marks.shape[1]):
        yes, of = np.bincount(word, marks[owner, v], len(keys)), marks[:, v].sum()
        odds[:, v] = (np.log((yes + 0.5) / (of + 1)) - np.log((df - yes + 0.5) / (len(n) - of + 1))) * df / (df + SHRUNK)
    keep = (df >= LEAST_DF) & (np.abs(odds).max(1, initial=0) >= LEAST_ODDS)
    return keys[keep], odds[keep]


def inputs(evidence: np.ndarray, dense: np.ndarray) -> np.ndarray:
    x = np.concatenate([evidence, dense], 1)
    return np.concatenate([x, x * x], 1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_softmax(x: np.ndarray, y: np.ndarray, k: int, rounds: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts by Adam on the whole sample; deterministic."""
    w, b = np.zeros((x.shape[1], k)), np.log(np.bincount(y, minlength=k) + 1.0)
    goal = np.eye(k)[y]
    m, v = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, rounds + 1):
        gap = (softmax(x @ w + b) - goal) / len(y)
        for i, (value, g) in enumerate(((w, x.T @ gap + 2e-5 * w), (b, gap.sum(0)))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            value -= 0.1 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-9)
    return w, b


def domain_of(labels: DataFrame, columns: tuple[str, ...]) -> Column:
    return F.concat_ws(",", *(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in columns))


def fit_classifier(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...] = DOMAINS, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Domains, telling words and the softmax weights, from a bounded sample of labelled rows."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(domain_of(labels, columns).alias("domain"), F.array(*values).alias("values")).alias("d")).groupBy("doc_id").agg(F.min("d").alias("d")).select("doc_id", "d.domain", "d.values")
    n = labelled.count()
    chosen = labelled.where(F.expr("(xxhash64(doc_id, 3) + 9223372036854775807D) / 18446744073709551614D") <= F.lit(sample / max(n, 1)))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    rows = texts.join(F.broadcast(chosen), "doc_id").toPandas()  # about SAMPLE rows
    rows = rows.sort_values(["doc_id", "text"]).reset_index(drop=True)
    names = sorted(set(rows["domain"])) or ["all"]
    if len(names) < 2:
        return {"names": names, "w": None}
    parts = [read([t.encode() for t in rows["text"][i : i + 500]]) for i in range(0, len(rows), 500)]
    words, sizes, dense = (np.concatenate(x) for x in zip(*parts, strict=True))
    given = np.array(rows["values"].tolist())
    marks = np.stack([(given[:, c] == v).astype(float) for c in range(len(columns)) for v in sorted(set(given[:, c]))[1:] or [""]], 1)
    # a text's evidence comes from words that the other half made telling, as an unseen text's does
    half, owner = np.arange(len(rows)) % 2, np.repeat(np.arange(len(rows)), sizes)
    found = np.zeros((len(rows), 4 * marks.shape[1]))
    for h in (0, 1):
        other = odds_table(words[half[owner] != h], sizes[half != h], marks[half != h])
        found[half == h] = evidence(other, words[half[owner] == h], sizes[half == h])
    x = inputs(found, dense)
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    w, b = fit_softmax((x - centre) / scale, rows["domain"].map(names.index).to_numpy(), len(names))
    return {"names": names, "odds": odds_table(words, sizes, marks), "w": w / scale[:, None], "b": b - (centre / scale) @ w}


def posterior(model: dict, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors and words of texts."""
    words, n, dense = read(texts)
    if model["w"] is None:
        return np.ones((len(texts), 1)), n
    return softmax(inputs(evidence(model["odds"], words, n), dense) @ model["w"] + model["b"]), n


def posteriors(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", tokens: str | None = None) -> DataFrame:
    """doc_id, n_tokens (words, or the named column's numbers) and p: the posterior of each domain."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # telling words of SAMPLE texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in in_blocks(batches, "text", 2_000_000, 1000):
            p, n = posterior(sent.value, block.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("tokens") if tokens else pa.array(n), pa.array(p.tolist(), pa.list_(pa.float64()))], names=["doc_id", "n_tokens", "p"])

    count = [F.coalesce(F.col(tokens).cast("long"), F.lit(0).cast("long")).alias("tokens")] if tokens else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), *count).mapInArrow(run, "doc_id long, n_tokens long, p array<double>")


def rate(p: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Rates after the steps: the last number of a step is its momentum, the others are its move by domain; each is projected onto r >= 0."""
    return _walk(p, steps)[0]


def _walk(p: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rates, the point that the next step starts from, and how far the last step moved each rate."""
    r = y = np.ones(len(p))
    moved = np.zeros(len(p))
    for s in steps:
        new = np.maximum(0.0, y - p @ s[:-1])
        moved = new - r
        r, y = new, new + s[-1] * moved
    return r, y, moved


def _matrix(b: pa.RecordBatch, k: int) -> np.ndarray:
    return b.column("p").flatten().to_numpy().reshape(-1, k)


def goals(names: list[str], natural: np.ndarray, targets: dict[str, float] | None, weights: dict[str, float] | None, budget: float | None) -> np.ndarray:
    """Wanted totals: multiples of natural ones (1 where not named), or shares of a budget of tokens, the natural share where not named."""
    if targets is not None:
        return np.array([targets.get(x, 1.0) for x in names]) * natural
    weights, total = WEIGHTS if weights is None else weights, natural.sum()
    share = np.array([weights.get(x, natural[i] / max(total, 1e-300)) for i, x in enumerate(names)])
    return share / max(share.sum(), 1e-300) * (BUDGET * total if budget is None else budget)


def solve(table: DataFrame, names: list[str], targets: dict[str, float] | None = None, weights: dict[str, float] | None = None, budget: float | None = None, most: int = STEPS) -> dict:
    """Steps for a posteriors table; targets: multiples of natural totals; else weights of a token budget."""
    k = len(names)

    def totals(steps: list[np.ndarray], gram: bool = False) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
        chain = np.array(steps).reshape(-1, k + 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(2 * k + 1 + k * k * gram)
            for b in batches:
                if len(b):
                    p, t = _matrix(b, k), b.column("n_tokens").to_numpy().astype(float)
                    r, y, moved = _walk(p, chain)
                    out[:k] += (t * r) @ p
                    out[k : 2 * k] += (t * y) @ p
                    out[2 * k] += t @ (moved * moved)
                    if gram:
                        out[2 * k + 1 :] += ((p * t[:, None]).T @ p).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], names=["at", "v"])

        rows = table.select("n_tokens", "p").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # a few rows a domain
        out = np.zeros(2 * k + 1 + k * k * gram)
        for r in rows:
            out[r["at"]] = r.v
        return out[:k], out[k : 2 * k], out[2 * k], out[2 * k + 1 :].reshape(-1, k)

    steps: list[np.ndarray] = []
    have, ahead, _, gram = totals(steps, True)
    natural, all_tokens = have, max(have.sum(), 1.0)
    want = goals(names, natural, targets, weights, budget)
    by = np.maximum(natural, 1e-9 * all_tokens)  # squared gaps count over natural totals
    size = 1 / max(np.linalg.eigvalsh(gram / np.sqrt(by)[:, None] / np.sqrt(by)[None, :])[-1], 1e-12)
    cost = lambda x: float(((x - want) ** 2 / by).sum())
    momentum, moved, costs, tried = 1.0, np.inf, [cost(have)], 0
    settled = lambda: len(costs) > STALL and costs[-1 - STALL] - costs[-1] <= 1e-6 * costs[-1]
    while tried < most and np.abs(have - want).max() > CLOSE * all_tokens and moved > CLOSE and not settled():
        tried += 1
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        step = np.concatenate([size * (ahead - want) / by, [(momentum - 1) / after]])
        now, then, far, _ = totals([*steps, step])
        if cost(now) > cost(have) and momentum > 1:  # overshot: the same place again, without its momentum
            steps[-1] = np.concatenate([steps[-1][:-1], [0.0]])
            momentum, ahead = 1.0, have
            continue
        steps, have, ahead, moved, momentum = [*steps, step], now, then, float(np.sqrt(far / all_tokens)), after
        costs.append(cost(have))
    gap = float(np.abs(have - want).max() / all_tokens)
    return {"names": names, "steps": np.array(steps).reshape(-1, k + 1), "natural": natural, "want": want, "have": have, "gap": gap, "converged": bool(gap <= CLOSE or moved <= CLOSE or settled())}


def copies_of(rate: Column, doc_id: Column) -> Column:
    """Whole copies whose mean over ids is the rate."""
    return F.floor(rate + F.pmod(F.xxhash64(F.coalesce(doc_id, F.lit(-1).cast("long")), F.lit(11)), F.lit(1_000_003)) / 1_000_003.0).cast("int")


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, weights: dict[str, float] | None = None, budget: float | None = None, id_col: str = "doc_id", text_col: str = "text", tokens: str | None = None) -> DataFrame:
    """doc_id, n_tokens, domain (likeliest), p, rate, copies of every row, and of the whole its largest gap as a share of all tokens, and converged."""
    model = fit_classifier(docs, labels, id_col=id_col, text_col=text_col)
    table = written(posteriors(docs, model, id_col, text_col, tokens), work_dir(docs.sparkSession, "mixing"))
    found = solve(table, model["names"], targets, weights, budget)
    names, steps, k = model["names"], found["steps"], len(model["names"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _matrix(b, k)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), pa.array([names[i] for i in p.argmax(1)], pa.string()), b.column("p"), pa.array(np.round(rate(p, steps), 9))], names=["doc_id", "n_tokens", "domain", "p", "rate"])

    out = table.mapInArrow(run, "doc_id long, n_tokens long, domain string, p array<double>, rate double")
    return out.select("*", copies_of(F.col("rate"), F.col("doc_id")).alias("copies"), F.lit(found["gap"]).alias("gap"), F.lit(found["converged"]).alias("converged"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, weights: dict[str, float] | None = None, budget: float | None = None, id_col: str = "doc_id", text_col: str = "text", tokens: str | None = None) -> DataFrame:
    """The rows of docs, columns as they are, each as often as its copies say."""
    model = fit_classifier(docs, labels, id_col=id_col, text_col=text_col)
    table = written(posteriors(docs, model, id_col, text_col, tokens), work_dir(docs.sparkSession, "mixing"))
    steps = solve(table, model["names"], targets, weights, budget)["steps"]
    sent = docs.sparkSession.sparkContext.broadcast((model, steps))

    @F.arrow_udf("double")
    def rated(texts: pa.Array) -> pa.Array:
        own, chain = sent.value
        out = [np.zeros(0)]
        for block in in_blocks(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), "text", 2_000_000, 1000):
            out.append(np.round(rate(posterior(own, block.column("text").cast(pa.binary()).to_pylist())[0], chain), 9))
        return pa.array(np.concatenate(out))

    columns, extra = docs.columns, "copy"
    while extra in columns:
        extra += "_"
    times = F.array_repeat(F.lit(1), copies_of(rated(text_of(text_col)), F.col(id_col).cast("long")))
    return docs.select(*(F.col(f"`{c}`") for c in columns), times.alias(extra)).select(*(F.col(f"`{c}`") for c in columns), F.explode(extra).alias(extra)).drop(extra)
