"""Toxic spans by a linear-chain conditional random field.

Token labels come from labelled documents: a word or word beginning that is frequent in toxic documents
and nearly absent from clean ones marks the tokens of toxic documents that carry it. A two-state chain
is fitted to those tokens; its forward-backward marginals give the offending offsets, and the largest
marginal log-odds, the expected number of toxic tokens and their share of a document give its score by a small
logistic model.

The fit uses a bounded sample (``SAMPLE`` documents of each class of at most ``LONGEST`` characters, chosen by a hash of the
id, and ``TRAIN_TOKENS`` tokens of them in stretches of ``STRETCH``); scoring
covers every document and the whole of each text. Only words are inputs of a score.

Defined cases: null and empty texts, and texts without a letter, have no tokens and get the score of the
least toxic token with an expected count of 0; without labels of both classes every score is 0; rows that repeat
are scored row by row; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from secflow.llm.common import whole_text

#: Most labelled documents of each class that the fit reads, and characters of each at most: longer ones are not learnt from.
SAMPLE, LONGEST = 2000, 30_000
#: Most tokens of a training stretch, and tokens that all stretches have.
STRETCH, TRAIN_TOKENS = 40, 240_000
#: Characters of texts that take their steps together, about; words that a worker remembers.
SLICE, REMEMBERED = 4 << 20, 150_000
PREDICT_AT = 0.3
TOKEN = re.compile(r"[^\W\d_]+")
LIMIT = 20.0
SCHEMA = "score double, spans array<struct<start:int,end:int>>"


def held_out(ident: str = "doc_id") -> Column:
    """Rows that the fit must not learn from."""
    return F.crc32(F.coalesce(F.col(ident).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def features(word: str) -> list[str]:
    w = word.lower()
    return [f"w{w}", *(f"p{w[:k]}" for k in (3, 4, 5, 6, 7) if len(w) > k)]


@dataclass
class Chain:
    """Weights of the toxic state's features, four transition scores (from, to) and the document model."""

    weights: dict[str, float] = field(default_factory=dict)
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    document: np.ndarray | None = None
    known: dict[str, float] = field(default_factory=dict)

    def unary(self, word: str) -> float:
        found = self.known.get(word)
        if found is None:
            get = self.weights.get
            found = max(-LIMIT, min(LIMIT, get("bias", 0.0) + sum(get(f, 0.0) for f in features(word))))
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[word] = found
        return found


def log_odds(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Marginal log-odds of the toxic state for each token of many chains that lie one after another.

    With two states the forward and backward messages are one ratio each, so a step is a fraction of
    linear terms; all chains take a step together."""
    e, t = np.exp(scores), np.exp(moves)
    order = np.argsort(-lengths, kind="stable")
    at, size = starts[order], lengths[order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")
    ahead, back = np.empty_like(e), np.empty_like(e)
    a = np.ones(len(at))
    for i in range(steps):
        n = active[i]
        where = at[:n] + i
        a = a[:n]
        a = e[where] * (t[0, 1] + a * t[1, 1]) / (t[0, 0] + a * t[1, 0]) if i else e[where].copy()
        ahead[where] = a
    b = np.ones(len(at))
    for i in range(steps - 1, -1, -1):
        n, more = active[i], active[i + 1] if i + 1 < steps else 0
        if more:
            x = e[at[:more] + i + 1] * b[:more]
            b[:more] = (t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x)
        back[at[:n] + i] = b[:n]
    return np.log(ahead) + np.log(back)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def summary(odds: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each document: 1, its largest log-odds, and the logs of one plus its expected toxic tokens, all and in a thousand."""
    out = np.zeros((len(lengths), 4))
    out[:, 0], out[:, 1] = 1, -LIMIT
    some = lengths > 0
    if some.any():
        out[some, 1] = np.clip(np.maximum.reduceat(odds, starts[some]), -LIMIT, LIMIT)
        expected = np.add.reduceat(sigmoid(odds), starts[some])
        out[some, 2], out[some, 3] = np.log1p(expected), np.log1p(1000 * expected / lengths[some])
    return out


def toxic_features(texts: list[list[str]], toxic: np.ndarray) -> set[str]:
    """Features that mark toxic tokens: in 1.5 % of the toxic documents at least (five if there are few), and e^3
    times as likely there, with two clean documents more than were seen."""
    n1, n0 = toxic.sum(), (1 - toxic).sum()
    bad, clean = Counter(), Counter()
    for words, y in zip(texts, toxic, strict=True):
        if y:
            bad.update({f for w in set(words) for f in features(w)})
    bad = {f: k for f, k in bad.items() if k >= max(5, 0.015 * n1)}
    for words, y in zip(texts, toxic, strict=True):
        if not y:
            clean.update({f for w in set(words) for f in features(w) if f in bad})
    return {f for f, k in bad.items() if np.log(k / n1) - np.log((clean[f] + 2) / (n0 + 2)) > 3}


def stretches(texts: list[list[str]], marks: list[list[int]]) -> tuple[list[list[str]], list[list[int]]]:
    """Stretches of tokens for the fit, spread over all documents; those with toxic tokens come first."""
    cut = [(w[i : i + STRETCH], m[i : i + STRETCH]) for w, m in zip(texts, marks, strict=True) for i in range(0, len(w), STRETCH)]
    with_, without = [x for x in cut if any(x[1])], [x for x in cut if not any(x[1])]
    room = TRAIN_TOKENS // STRETCH
    with_ = with_[:: max(1, -(-2 * len(with_) // room))]
    without = without[:: max(1, len(without) // max(1, room - len(with_)))]
    chosen = with_ + without
    return [x[0] for x in chosen], [x[1] for x in chosen]


def fit_chain(words: list[list[str]], marks: list[list[int]], rounds: int = 60, ridge: float = 0.05) -> Chain:
    """Maximum likelihood of the token labels by accelerated gradient steps scaled by each weight's history."""
    counts = Counter(f for ws in words for w in ws for f in features(w))
    index = {f: i + 1 for i, f in enumerate(sorted(f for f, n in counts.items() if n >= 3))}
    lengths = np.array([len(w) for w in words])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    flat = [w for ws in words for w in ws]
    rows = [[0, *(index[f] for f in features(w) if f in index)] for w in flat]
    of = np.repeat(np.arange(len(flat)), [len(r) for r in rows])
    cols = np.fromiter((i for r in rows for i in r), dtype=np.int64)
    y = np.array([m for ms in marks for m in ms], dtype=float)
    inner = np.ones(len(flat), bool)
    inner[starts] = False
    later = np.flatnonzero(inner)
    w, moves = np.zeros(len(index) + 1), np.zeros((2, 2))
    past, past_moves = np.full(len(w), 1e-8), np.full((2, 2), 1e-8)
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (y[later - 1].astype(int), y[later].astype(int)), 1)
    for _ in range(rounds):
        u = np.clip(np.bincount(of, weights=w[cols], minlength=len(flat)), -LIMIT, LIMIT)
        odds = log_odds(u, starts, lengths, moves)
        p = sigmoid(odds)
        grad = np.bincount(cols, weights=(y - p)[of], minlength=len(w)) - ridge * w
        # expected moves between neighbours, from the ratios on both sides of each pair
        ahead, back = pair_messages(u, starts, lengths, moves)
        t, x = np.exp(moves), np.exp(u[later])
        joint = np.stack([t[0, 0] * np.ones(len(later)), t[0, 1] * x * back[later], ahead[later - 1] * t[1, 0],
                          ahead[later - 1] * t[1, 1] * x * back[later]])
        joint /= joint.sum(0)
        grad_moves = seen_moves - joint.sum(1).reshape(2, 2) - ridge * moves
        past += grad**2
        past_moves += grad_moves**2
        w += 0.7 * grad / np.sqrt(past)
        moves = np.clip(moves + 0.2 * grad_moves / np.sqrt(past_moves), -4, 4)
    names = {"bias": 0} | index
    return Chain({f: float(w[i]) for f, i in names.items() if abs(w[i]) > 1e-3}, moves)


def pair_messages(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward ratios (without the token's own factor in the backward one)."""
    e, t = np.exp(scores), np.exp(moves)
    ahead, back = e.copy(), np.ones_like(e)
    top = int(lengths.max()) if len(lengths) else 0
    for i in range(1, top):
        where = starts[lengths > i] + i
        a = ahead[where - 1]
        ahead[where] = e[where] * (t[0, 1] + a * t[1, 1]) / (t[0, 0] + a * t[1, 0])
    for i in range(top - 2, -1, -1):
        where = starts[lengths > i + 1] + i
        x = e[where + 1] * back[where + 1]
        back[where] = (t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x)
    return ahead, back


def fit_document(x: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """Logistic weights by Newton steps on a balanced sample, moved to the share of toxic documents."""
    w, size = np.zeros(x.shape[1]), np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    ridge = np.array([1e-3, *[1.0] * (x.shape[1] - 1)])
    for _ in range(25):
        p = sigmoid(x @ w)
        h = (x * (size * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w += np.linalg.solve(h, x.T @ (size * (y - p)) - ridge * w)
    w[0] += np.log(prior / (1 - prior))
    return w


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, sample: int) -> tuple[list[tuple[str, int]], float]:
    """At most ``sample`` labelled texts of each class, and the share of toxic documents among all usable labels."""
    marked = labels.where(usable & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").dropDuplicates(["doc_id"])
    n = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    chosen = [marked.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    # at most 2 * sample rows of two numbers: a proven bound
    texts = docs.select("doc_id", whole_text().alias("text")).where(F.length("text") <= LONGEST).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    rows = texts.dropDuplicates(["text", "toxic"]).orderBy("doc_id", "text").collect()
    total = sum(n.values())
    return [(r["text"], r["toxic"]) for r in rows], (n.get(1, 0) / total if total else 0.0)


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample: int = SAMPLE) -> Chain:
    """The chain and the document model, fitted to the usable labels."""
    rows, share = training_rows(docs, labels, F.lit(True) if usable is None else usable, sample)
    y = np.array([t for _, t in rows])
    if not 0 < y.sum() < len(y):
        return Chain()
    words = [[sys.intern(w) for w in TOKEN.findall(text)] for text, _ in rows]
    marking = toxic_features(words, y)
    marks = [[int(bool(t) and any(f in marking for f in features(w))) for w in ws] for ws, t in zip(words, y, strict=True)]
    chain = fit_chain(*stretches(words, marks))
    seen = [summary(*chain_odds(chain, words[i : i + 500])) for i in range(0, len(words), 500)]
    chain.document = fit_document(np.concatenate(seen), y, min(max(share, 1e-3), 0.5))
    chain.known = {}
    return chain


def chain_odds(chain: Chain, words: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds of the tokens of some texts. The words of one text only are held at a time."""
    known, unary = chain.known, chain.unary
    u = [np.array([known[w] if w in known else unary(w) for w in ws], dtype=float) for ws in words]
    lengths = np.array([len(x) for x in u], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    return log_odds(np.concatenate(u) if u else np.empty(0), starts, lengths, chain.moves), starts, lengths


def tagged(chain: Chain, texts: list[str]) -> tuple[np.ndarray, list[list[dict]]]:
    """Scores and toxic spans of some texts."""
    if chain.document is None:
        return np.zeros(len(texts)), [[] for _ in texts]
    odds, starts, lengths = chain_odds(chain, map(TOKEN.findall, texts))
    scores = sigmoid(summary(odds, starts, lengths) @ chain.document)
    spans: list[list[dict]] = []
    bad = odds > 0
    for text, start, n in zip(texts, starts, lengths, strict=True):
        mine: list[dict] = []
        if bad[start : start + n].any():
            for m, hit in zip(TOKEN.finditer(text), bad[start : start + n], strict=True):
                if hit:
                    mine.append({"start": m.start(), "end": m.end()})
        spans.append(mine)
    return scores, spans


def tagged_batch(chain: Chain, batch: pd.Series) -> tuple[np.ndarray, list[list[dict]]]:
    """``tagged`` for a batch, slice by slice. Texts of like length go together, so few slices take as many steps as a long text has."""
    texts = batch.tolist()
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    scores, spans = np.zeros(len(texts)), [[] for _ in texts]
    at = 0
    while at < len(order):
        end, size = at, 0
        while end < len(order) and (end == at or size + len(texts[order[end]]) <= SLICE):
            size += len(texts[order[end]])
            end += 1
        some = order[at:end]
        scores[some], found = tagged(chain, [texts[i] for i in some])
        for i, mine in zip(some, found, strict=True):
            spans[i] = mine
        at = end
    return scores, spans


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, with ``score`` and the offending ``spans`` (code points)."""
    held = docs.sparkSession.sparkContext.broadcast(chain)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            scores, spans = tagged_batch(held.value, batch)
            yield pd.DataFrame({"score": scores, "spans": spans})

    tag = F.pandas_udf(run, SCHEMA)
    return docs.withColumn("_tag", tag(whole_text(text_col))).select(*[c for c in docs.columns if c != text_col], "_tag.score", "_tag.spans")


def clean_rows(docs: DataFrame, chain: Chain, text_col: str = "text", at: float = PREDICT_AT) -> DataFrame:
    """``docs`` without the rows that the chain rejects."""
    held = docs.sparkSession.sparkContext.broadcast(chain)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(tagged_batch(held.value, batch)[0], dtype=float)

    return docs.where(F.pandas_udf(run, "double")(whole_text(text_col)) < at)
