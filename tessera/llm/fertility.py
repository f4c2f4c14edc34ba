"""Quality rules: tokeniser fertility with rejection bands per language.

Public vocabularies (their paths are a parameter, nothing is trained) split
every word of the whole text.  Per document and vocabulary:

* ``chars_per_token``: code points in words per token;
* ``fallback_share``: share of tokens that are no whole characters, that is
  where the vocabulary falls back to bytes;

and, under the first one:

* ``entropy``: Shannon entropy of the document's tokens, as a share of what
  a text of that many tokens can reach (``log2(min(tokens, 512))``).

``bands`` takes the quartiles of each figure over *all* documents of a group
(language column, or script where there is none) that pass the base rules; a
document with a figure outside ``[q1 - 2*iqr, q3 + 3*iqr]``, on the side where
junk lies, under most of the vocabularies is rejected, at every size.  Labelled
junk shows in low figures, so those limits are the narrower ones; high figures
are more often those of good texts.

Defined results: null and empty texts have no words and fail the base rules;
a null language is a group of its own; groups with a spread below the least
one use that; repeated rows are judged one by one; an empty table gives no
rows.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, vocabulary
from .piece_codec import SPACE, PieceModel

#: Files of public vocabularies; entropy is that of the first one's tokens.
VOCABULARIES = ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken")
SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
#: Bytes of words and tokens in a generation of a task's table.
CACHE = 16 << 20
#: Bytes of text whose words are split at once, and words encoded at once.
PIECE = 1 << 20
LEARN = 50_000
MIN_WORDS = 50
#: Width of the bands in interquartile ranges, below and above the quartiles.
BELOW, ABOVE = 2.0, 3.0
#: Per figure: (column, reject below, reject above, least interquartile range).
FIGURES = (("chars_per_token", BELOW, ABOVE, 0.08), ("fallback_share", None, ABOVE, 0.01), ("entropy", BELOW, None, 0.02))

STATS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
         "n_tokens long, chars_per_token double, fallback_share double, entropy double, script string")


def base_counts(data: bytes) -> tuple[list[bytes], np.ndarray, int, int, int, int]:
    """Words, byte histogram, and the counts of the base rules."""
    ws = data.split()  # bytes.split() knows exactly the six ASCII white-space characters
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars = len(data) - int(hist[0x80:0xC0].sum()) - int(hist[list(SPACES)].sum())
    symbols = int(hist[list(SYMBOLS)].sum())
    dup = 0
    if hist[10]:
        lines = [line for line in data.split(b"\n") if line.strip()]
        dup = len(lines) - len(set(lines))
    return ws, hist, chars, symbols, dup, repeated_words(ws)


def repeated_words(ws: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(ws) < 4:
        return 0
    h = np.fromiter(map(hash, ws), np.int64, len(ws)).astype(np.uint64)
    mixed = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():  # equal windows have equal hashes
        return 0
    windows = list(zip(ws, ws[1:], ws[2:]))
    seen = Counter(windows)
    repeat = upto = 0  # words before upto are counted
    for i, w in enumerate(windows):
        if seen[w] > 1:
            repeat += i + 3 - max(i, upto)
            upto = i + 3
    return repeat


def script_of(lead: np.ndarray) -> str:
    """Coarse script of most letters, from the histogram of UTF-8 bytes."""
    latin = lead[0x41:0x5B].sum() + lead[0x61:0x7B].sum() + lead[0xC3:0xCA].sum()
    rest = {"greek": lead[0xCD:0xD0].sum(), "cyrillic": lead[0xD0:0xD4].sum(), "semitic": lead[0xD6:0xDC].sum(),
            "indic": lead[0xE0:0xE1].sum(), "east_asian": lead[0xE3:0xEE].sum(), "latin": latin}
    best = max(rest, key=lambda k: (rest[k], k))
    return best if rest[best] else "none"


class RankFile:
    """Words under a byte-level BPE vocabulary: a file of tokens and ranks."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoder = tiktoken.Encoding("words", pat_str=r" [^ ]+", mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.partial = np.zeros(len(self.size), bool)
        for token, i in ranks.items():
            self.size[i] = len(token)
            try:
                token.decode("utf-8")
            except UnicodeDecodeError:
                self.partial[i] = True

    def encode(self, ws: list[bytes]) -> list[bytes]:
        """The 32-bit ids of each word, with a space before it."""
        ids = np.array(self.encoder.encode_ordinary((b" " + b" ".join(ws)).decode()), np.int32)
        ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(w) + 1 for w in ws])) + 1
        flat, stops = ids.tobytes(), (ends * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *stops], stops)]


class PieceFile:
    """The same under a vocabulary of pieces with byte fallback."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.partial = self.model.is_byte

    def encode(self, ws: list[bytes]) -> list[bytes]:
        return self.model.merge([SPACE + w for w in ws])


class WordTokens:
    """Ids by word under the first vocabulary, and under each of the others the
    number of tokens and of those that are no whole characters.

    Words of a batch that aren't known yet are encoded together.  Two
    generations of words are kept within ``CACHE`` bytes each; those not met
    since the younger one was begun are forgotten when it is full."""

    def __init__(self, paths: list[str]):
        self.coders = [(PieceFile if p.endswith(".model") else RankFile)(p) for p in paths]
        self.partial = self.coders[0].partial
        self.young: dict[bytes, tuple[bytes, bytes]] = {}
        self.old: dict[bytes, tuple[bytes, bytes]] = {}
        self.used = 0

    def learn(self, ws: set[bytes]) -> None:
        """Make sure that all words are in the younger generation."""
        new = ws - self.young.keys()
        if new and self.used > CACHE:
            self.old, self.young, self.used, new = self.young, {}, 0, ws
        known = new & self.old.keys()
        self.young.update((w, self.old[w]) for w in known)
        rest = list(new - known)
        for a in range(0, len(rest), LEARN):
            part = rest[a:a + LEARN]
            first, *others = (c.encode(part) for c in self.coders)
            counts = np.zeros((len(part), len(others), 2), np.uint32)
            for k, ids in enumerate(others):
                n = np.fromiter(map(len, ids), np.int64, len(part)) // 4
                partial = self.coders[k + 1].partial[np.frombuffer(b"".join(ids), np.int32)]
                upto = np.r_[0, np.cumsum(partial)]
                stops = np.cumsum(n)
                counts[:, k, 0], counts[:, k, 1] = n, upto[stops] - upto[stops - n]
            flat, width = counts.tobytes(), 8 * len(others)
            self.young.update(zip(part, zip(first, (flat[i:i + width] for i in range(0, width * len(part), width))
                                            if width else [b""] * len(part))))
        # A token takes 4 bytes, at least one of the word's.
        self.used += 5 * sum(map(len, new)) + (300 + 8 * len(self.coders)) * len(new)

    def encode(self, ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of learned words, and the sums of the others' (tokens, partial ones)."""
        found = list(map(self.young.__getitem__, ws))
        rest = np.frombuffer(b"".join([b for _, b in found]), np.uint32).astype(np.int64)
        return (np.frombuffer(b"".join([a for a, _ in found]), np.int32),
                rest.reshape(len(ws), len(self.coders) - 1, 2).sum(axis=0))


def text_stats(texts: Iterable[str | None], tokens: WordTokens) -> list[tuple]:
    out, texts = [], iter(texts)
    while True:  # learn the words of about PIECE bytes at once
        part, size = [], 0
        for text in texts:
            data = (text or "").encode("utf-8", "replace")
            part.append(base_counts(data))
            size += len(data)
            if size >= PIECE:
                break
        if not part:
            return out
        tokens.learn({w for p in part for w in p[0]})
        for ws, hist, chars, symbols, dup, repeat in part:
            n, fallback, entropy = 0, 0, 0.0
            others = np.zeros((len(tokens.coders) - 1, 2), np.int64)
            if ws:
                ids, others = tokens.encode(ws)
                n, fallback = len(ids), int(tokens.partial[ids].sum())
                if n > 1:
                    p = np.unique(ids, return_counts=True)[1] / n
                    entropy = min(1.0, float(-(p @ np.log2(p))) / float(np.log2(min(n, 512))))
            more = [x for m, f in others.tolist() for x in (chars / max(1, m), f / max(1, m))]
            out.append((len(ws), chars, symbols, dup, repeat, n, chars / max(1, n), fallback / max(1, n), entropy,
                        script_of(hist), *more))


def measure(docs: DataFrame, keep: list[str], *, text_col: str = "text",
            vocabularies: list[str] | None = None) -> DataFrame:
    """``keep`` columns and the figures of every document, under the
    vocabularies at the given paths.  ``keep`` may hold the text itself; it
    must not use the names of the figures."""
    paths = [vocabulary(v) for v in VOCABULARIES] if vocabularies is None else vocabularies
    src = docs.select(*keep) if text_col in keep else docs.select(*keep, F.col(text_col).alias("_text"))
    at = keep.index(text_col) if text_col in keep else len(keep)
    stats = ", ".join([STATS, *[f"chars_per_token_{k} double, fallback_share_{k} double" for k in range(2, len(paths) + 1)]])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:len(keep)])
    names = [s.split()[0] for s in stats.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = batch = None  # end with the task
        for batch in batches:
            tokens = tokens or WordTokens(paths)
            rows = text_stats((t.as_py() for t in batch.column(at)), tokens)
            if rows:
                yield pa.record_batch([*batch.columns[:len(keep)], *map(pa.array, zip(*rows))], [*keep, *names])
        del tokens, batch
        give_back()

    return src.mapInArrow(run, f"{schema}, {stats}")


def base_failed(n_words="n_words", n_repeat="n_repeat_words") -> Column:
    return (F.col(n_words) < MIN_WORDS) | (100 * F.col(n_repeat) > 50 * F.col(n_words))


def figures(stats: DataFrame) -> list[tuple]:
    """(column, reject below, reject above, least interquartile range) of all
    figures that ``stats`` has."""
    more = [(f"{c}_{k}", low, high, least) for k in range(2, 10) for c, low, high, least in FIGURES
            if f"{c}_{k}" in stats.columns]
    return [*FIGURES, *more]


def bands(stats: DataFrame, group: Column) -> DataFrame:
    """Per group: the limits of each figure, from its quartiles over all
    documents that pass the base rules."""
    found = figures(stats)
    aggs = [F.percentile_approx(c, [0.25, 0.75], 10_000).alias(c) for c, *_ in found]
    q = stats.where(~base_failed()).groupBy(group.alias("_group")).agg(*aggs)
    cols = [F.col("_group")]
    for c, low, high, least in found:
        spread = F.greatest(F.col(c)[1] - F.col(c)[0], F.lit(least))
        cols.append((F.col(c)[0] - low * spread if low else F.lit(None).cast("double")).alias(f"{c}_low"))
        cols.append((F.col(c)[1] + high * spread if high else F.lit(None).cast("double")).alias(f"{c}_high"))
    return q.select(*cols)


def judge(stats: DataFrame, limits: DataFrame, group: Column) -> DataFrame:
    """Add ``base_failed`` and ``kept``.  ``limits`` has one row per language
    or script; a group without a row has no document that passes the base rules."""
    out = stats.withColumn("_group", group).withColumn("base_failed", base_failed())
    inside = F.lit(True)
    for name, *_ in FIGURES:
        under = [c for c, *_ in figures(stats) if c == name or c.startswith(f"{name}_")]
        outside = [F.coalesce((F.col(c) < F.col(f"{c}_low")) | (F.col(c) > F.col(f"{c}_high")), F.col(c) < F.col(f"{c}_low"),
                              F.col(c) > F.col(f"{c}_high"), F.lit(False)).cast("int") for c in under]
        inside &= 2 * reduce(lambda a, b: a + b, outside) <= len(under)
    extra = [n for n in limits.columns if n != "_group"]
    joined = out.join(limits.withColumnRenamed("_group", "_g"), F.col("_group").eqNullSafe(F.col("_g")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & inside).drop("_group", "_g", *extra)
