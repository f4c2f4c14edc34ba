"""Language identification: averaged hashed subword embeddings, linear softmax.

A text is the mean of the embeddings of its character 2- to 4-grams (inside
words, with word edges), hashed into ``BUCKETS`` rows.  A linear softmax
reads that mean.  Embeddings and softmax are trained together by stochastic
gradient descent in numpy on snippets of 1 to 80 words, so that short texts
are covered.  A held-back part of the training documents calibrates the
softmax temperature and the rejection threshold: the smallest confidence at
which ``PRECISION`` of the accepted snippets are right.

Since mean and softmax are linear, prediction folds embedding and softmax
into one table of logits per bucket; a whole text costs one table look-up per
gram, in pieces of bounded size.

Defined results: null texts and texts without a letter are ``und`` with score
0 and rejected; without training rows everything is ``und``; ties go to the
first language by code point; repeated rows are predicted one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

BUCKETS = 1 << 15
DIM = 16
#: About this many documents per language are fetched for training.
DOCS_PER_LANG = 500
SNIPPETS = 10
EPOCHS = 5
PRECISION = 0.98
PIECE = 1 << 19


def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, bucket) of the grams of each order; 32 marks whatever is not a letter."""
    c = codes.astype(np.uint32)
    edge = c == 32
    h = [c * np.uint32(0x9E3779B1), c * np.uint32(0x85EBCA77), c * np.uint32(0xC2B2AE3D), c * np.uint32(0x27D4EB2F)]
    out = []
    for n in (2, 3, 4):
        m = len(c) - n + 1
        if m <= 0:
            break
        acc = np.full(m, n, np.uint32)
        for k in range(n):
            acc += h[k][k:k + m]
        ok = ~(edge[:m] & edge[1:1 + m]) if n == 2 else ~edge[1:1 + m]
        if n == 4:
            ok &= ~edge[2:2 + m]
        at = np.flatnonzero(ok)
        acc = acc[at]
        acc ^= acc >> np.uint32(15)
        acc *= np.uint32(0x2C1B3C6D)
        out.append((at, (acc >> np.uint32(32 - 15)).astype(np.int64)))
    return out


def codes_of(text: str, letters: np.ndarray) -> np.ndarray:
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32)
    return np.where(letters[c], c, np.uint32(32))


@dataclass
class LangModel:
    langs: list[str]
    table: np.ndarray  # logits by bucket and language, temperature included
    bias: np.ndarray
    reject_below: float

    def predict(self, texts: list[str | None], letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        n, k = len(texts), len(self.langs)
        names, score, accepted = ["und"] * n, np.zeros(n), np.zeros(n, bool)
        if not k:
            return names, score, accepted
        sums, counts, some = np.zeros((n, k)), np.zeros(n), np.zeros(n, bool)
        columns = [np.ascontiguousarray(self.table[:, j]) for j in range(k)]
        start = 0
        while start < n:  # as many texts at once as fit a piece; a longer text alone, piece by piece
            codes, stop, size = [], start, 0
            while stop < n and (stop == start or size < PIECE):
                codes.append(codes_of(texts[stop] or "", letters))
                size += len(codes[-1])
                stop += 1
            owner = np.repeat(np.arange(start, stop), [len(c) for c in codes])
            whole = np.concatenate(codes)
            some |= np.bincount(owner[whole != 32], minlength=n).astype(bool)
            for a in range(0, len(whole), PIECE):
                for order, (at, bucket) in enumerate(grams(whole[a:a + PIECE + 3]), 2):
                    last = PIECE if a + PIECE < len(whole) else len(whole)
                    inside = (at < last) & (at + a + order <= len(whole))
                    at, bucket = at[inside], bucket[inside]
                    own = owner[at + a]
                    counts += np.bincount(own, minlength=n)
                    for j in range(k):
                        sums[:, j] += np.bincount(own, columns[j][bucket], minlength=n)
            start = stop
        z = sums / np.maximum(counts, 1)[:, None] + self.bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        for i in np.flatnonzero(some):
            names[i], score[i] = self.langs[best[i]], p[i, best[i]]
        accepted = some & (score >= self.reject_below)
        return names, score, accepted


def _snippets(texts: list[str], ys: list[int], rng, letters) -> list[tuple[np.ndarray, int]]:
    out = []
    for text, y in zip(texts, ys):
        ws = text.split()
        for _ in range(SNIPPETS):
            size = int(np.exp(rng.uniform(0, np.log(80))))
            a = int(rng.integers(max(1, len(ws) - size + 1)))
            found = [b for _, b in grams(codes_of(" ".join(ws[a:a + size]), letters))]
            ids = np.concatenate(found) if found else np.empty(0, np.int64)
            if len(ids):
                out.append((ids, y))
    return out


def fit_texts(texts: list[str], langs: list[str], *, seed: int = 0) -> LangModel:
    """Train on (text, language) rows held in memory."""
    names = sorted(set(langs))
    if not names:
        return LangModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    rng, letters = np.random.default_rng(seed), letter_table()
    ys = [names.index(x) for x in langs]
    data = _snippets(texts, ys, rng, letters)
    own = np.arange(len(data)) // SNIPPETS % 5 == 4  # every fifth document calibrates
    train, held = [d for d, o in zip(data, own) if not o], [d for d, o in zip(data, own) if o]
    k = len(names)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    w, b = np.zeros((k, DIM)), np.zeros(k)
    total, done, size = max(1, EPOCHS * len(train)), 0, 16

    def pooled(batch):
        lens = np.array([len(i) for i, _ in batch])
        ids = np.concatenate([i for i, _ in batch])
        return ids, lens, np.add.reduceat(emb[ids], np.r_[0, np.cumsum(lens)[:-1]], axis=0) / lens[:, None]

    for _ in range(EPOCHS):
        order = rng.permutation(len(train))
        for a in range(0, len(order), size):
            batch = [train[i] for i in order[a:a + size]]
            ids, lens, h = pooled(batch)
            z = h @ w.T + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), [y for _, y in batch]] -= 1
            rate = 0.3 * (1 - done / total)
            dh = p @ w / lens[:, None]
            w -= rate * p.T @ h
            b -= 0.1 * rate * p.sum(0)
            np.subtract.at(emb, ids, 20 * rate * np.repeat(dh, lens, axis=0))
            done += len(batch)
    temperature, reject = 1.0, 0.0
    if held:
        z, y = [], np.array([y for _, y in held])
        for a in range(0, len(held), 256):
            z.append(pooled(held[a:a + 256])[2] @ w.T + b)
        z = np.vstack(z)

        def softmax(t):
            e = np.exp(z / t - (z / t).max(1, keepdims=True))
            return e / e.sum(1, keepdims=True)

        grid = np.exp(np.linspace(-3, 3, 61))
        temperature = float(min(grid, key=lambda t: -np.log(softmax(t)[np.arange(len(y)), y] + 1e-12).mean()))
        p = softmax(temperature)
        top, right = p.max(1), p.argmax(1) == y
        order = np.argsort(-top)
        precise = np.cumsum(right[order]) / np.arange(1, len(y) + 1) >= PRECISION
        reject = float(top[order][np.flatnonzero(precise)[-1]]) if precise.any() else 1.0
    return LangModel(names, (emb @ w.T / temperature), b / temperature, reject)


def fit_languages(docs: DataFrame, train: Column, *, lang_col: str = "lang", text_col: str = "text",
                  id_col: str = "doc_id", docs_per_lang: int = DOCS_PER_LANG) -> LangModel:
    """Learn from a bounded sample of the rows with a language for which
    ``train`` holds: a hash of the id thins each language to about
    ``docs_per_lang`` documents."""
    rows = docs.select(id_col, lang_col, text_col).where(
        F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & train)
    counts = rows.groupBy(lang_col).count().collect()
    draw = F.pmod(F.xxhash64(F.lit("fit"), id_col), F.lit(1 << 20)) / float(1 << 20)
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col(lang_col) == r[lang_col], min(1.0, docs_per_lang / r["count"])).otherwise(share)
    got = sorted((r[lang_col], r[text_col]) for r in rows.where(draw < share).select(lang_col, text_col).collect())
    order = np.random.default_rng(1).permutation(len(got))
    return fit_texts([got[i][1] for i in order], [got[i][0] for i in order])


def identify(docs: DataFrame, model: LangModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred``, ``score`` and ``accepted`` for every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    made: list[np.ndarray] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(letter_table())
        names, score, accepted = model.predict(batch.column(1).to_pylist(), made[0])
        return pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(accepted)],
                               [id_col, "lang_pred", "score", "accepted"])

    return map_batches(docs.select(id_col, text_col), run,
                       f"`{id_col}` {kind}, lang_pred string, score double, accepted boolean")
