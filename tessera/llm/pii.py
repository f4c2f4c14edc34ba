"""Personal data: span candidates ranked by gradient-boosted trees.

High-recall generators propose overlapping spans of four kinds (email, ip,
card, phone) in every whole text, far wider than the exact base patterns.
Each candidate is described by its format (digits, groups, separators, check
sum, ...) and its context (neighbouring characters, cue words before it).
Boosted regression trees, grown here in numpy with logistic loss, give it a
probability; per kind, a threshold calibrated on held-back candidates selects
spans.  Training needs no manual labels and sees only candidates that no base
pattern covers, as those are the ones to decide on.  In a bounded sample of
documents every base span is rewritten, in its place, into forms that the base
patterns miss (``disguises``): positive where the form or a cue word before it
tells, negative where the same look-alike stands without a cue.  The free
candidates of the texts themselves are negative if they have no cue either.

Redaction = every base span, plus the selected candidates that overlap
neither a base span nor a better candidate.

Defined results: null and empty texts have no spans; offsets are code points,
ends are exclusive; among equal candidates the earlier, then the longer one
wins; repeated rows are treated one by one; without a positive candidate of a
kind the method adds no span of that kind.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

KINDS = ("email", "ip", "card", "phone")
#: Candidates and base spans of one document that the trees may learn from.
CANDIDATES_PER_DOC, SPANS_PER_DOC = 50, 8
#: About this many documents are searched for candidates to learn from.
MAX_DOCS = 20_000
PRECISION = 0.99
ROUNDS, DEPTH, RATE, BINS = 40, 3, 0.3, 32

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# No match begins inside a run of digits, so the look-behind changes no result
# but keeps the time linear in a long run.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]+")

WIDE_EMAIL = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}(?:\s?(?:@|\(at\)|\[at\]|\{at\})\s?)[A-Za-z0-9-]{1,63}"
    r"(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\})\s?[A-Za-z0-9-]{1,63})+")
WIDE_NUMBER = re.compile(r"[+(]?[0-9](?:[\x20().\-/:]{0,2}[0-9]){6,24}")
#: A dot that ends a sentence is no part of a domain.
TIGHT_EMAIL = re.compile(
    r"[A-Za-z0-9._%+-]{1,64}(?:\s?(?:@|\(at\)|\[at\]|\{at\})\s?)[A-Za-z0-9-]{1,63}"
    r"(?:(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\})\s?)[A-Za-z0-9-]{1,63})+")
CUES = re.compile(r"(?i)(phone|tel|mobile|call|fax)|(card|visa|credit|pay)|(\bip\b|host|server|addr)|(mail|contact|write)")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def email_spans(text: str) -> list[tuple[int, int]]:
    """What ``EMAIL.finditer`` finds, in time linear in the text: from every
    ``@`` to the left over the local part, then the domain."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the fixed patterns, leftmost and non-overlapping
    per kind; a match that fails its test is dropped without another try."""
    out = [(0, a, b) for a, b in email_spans(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = DIGITS.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(DIGITS.sub("", m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Overlapping spans that may be personal data, with high recall."""
    out = []
    if "@" in text or "at)" in text or "at]" in text or "at}" in text:
        wide = [(0, *m.span()) for m in WIDE_EMAIL.finditer(text)]
        out += wide + sorted({(0, *m.span()) for m in TIGHT_EMAIL.finditer(text)} - set(wide))
    for m in WIDE_NUMBER.finditer(text):
        s = m[0]
        digits = len(DIGITS.sub("", s))
        if s.count(".") >= 3:
            out.append((1, *m.span()))
        if 12 <= digits <= 19:
            out.append((2, *m.span()))
        if 7 <= digits <= 15:
            out.append((3, *m.span()))
    return out


def features(text: str, kind: int, a: int, b: int) -> list[float]:
    s = text[a:b]
    digits = DIGITS.sub("", s)
    groups = [len(g) for g in re.findall(r"[0-9]+", s)]
    before, after = text[a - 1:a], text[b:b + 1]
    cue = [0.0] * 4
    for m in CUES.finditer(text, max(0, a - 40), a):
        cue[m.lastindex - 1] = 1.0
    parts = s.split(".")
    return [float(kind), float(len(s)), float(len(digits)), len(digits) / len(s), float(len(groups)),
            float(max(groups, default=0)), float(min(groups, default=0)), float(groups[0] if groups else 0),
            float(groups[-1] if groups else 0), float(s[0] == "+"), float("(" in s), float(s.count("-")),
            float(s.count(" ")), float(s.count(".")), float(s.count("/") + s.count(":")), float(s.count("@")),
            float(len(digits) >= 12 and luhn(digits)),
            float(len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) <= 255 for p in parts)),
            float(before.isalnum()), float(after.isalnum()), float(bool(before) and before in "=\"'/_#"),
            float(bool(after) and after in "\"'/_%"), float(len(parts[-1])), float(parts[-1].isalpha()),
            float("(" in s or "[" in s or "{" in s), *cue]


@dataclass
class Trees:
    """Each round is a full tree of ``DEPTH`` levels: split features and cuts
    in heap order, then leaf values."""

    base: float
    splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    threshold: tuple[float, ...]

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.splits:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            z += leaf[node - (2 ** DEPTH - 1)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Trees:
    """Boosting on the rows that aren't held back; per kind, the threshold is
    the lowest one, at least 0.5, above which ``PRECISION`` of the held-back
    candidates are right."""
    never = Trees(-30.0, [], (1.1,) * len(KINDS))
    xt, yt = x[~held], y[~held]
    if not len(xt) or yt.min() == yt.max():
        return never
    cuts = [np.unique(np.quantile(xt[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, xt[:, j], side="left") for j, c in enumerate(cuts)], 1)
    rate = float(np.clip(yt.mean(), 1e-3, 1 - 1e-3))
    model = Trees(float(np.log(rate / (1 - rate))), [], ())
    z = np.full(len(xt), model.base)
    inner = 2 ** DEPTH - 1
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-z))
        g, h = yt - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(xt), np.int64)
        for level in range(DEPTH):
            for n in range(2 ** level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == n)
                best = 1e-6
                if len(rows):
                    gs, hs = g[rows].sum(), h[rows].sum()
                    for j, c in enumerate(cuts):
                        if not len(c):
                            continue
                        bj = bins[rows, j]
                        gl = np.cumsum(np.bincount(bj, g[rows], len(c) + 1))[:-1]
                        hl = np.cumsum(np.bincount(bj, h[rows], len(c) + 1))[:-1]
                        gain = gl ** 2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs ** 2 / (hs + 1)
                        k = int(gain.argmax())
                        if gain[k] > best:
                            best, feature[n], cut[n] = gain[k], j, c[k]
            node = 2 * node + 1 + (xt[np.arange(len(xt)), feature[node]] > cut[node])
        at = node - inner
        leaf = RATE * np.bincount(at, g, 2 ** DEPTH) / (np.bincount(at, h, 2 ** DEPTH) + 1)
        model.splits.append((feature, cut, leaf))
        z += leaf[at]
    limits = []
    p = model.probability(x[held]) if held.any() else np.zeros(0)
    for kind in range(len(KINDS)):
        mine = x[held][:, 0] == kind if held.any() else np.zeros(0, bool)
        pk, yk = p[mine], y[held][mine]
        order = np.argsort(-pk, kind="stable")
        right = np.cumsum(yk[order]) / np.arange(1, len(order) + 1)
        ok = np.flatnonzero((right >= PRECISION) & (yk[order] == 1))
        if len(ok):  # half-way to the next candidate below
            below = float(pk[order][ok[-1] + 1]) if ok[-1] + 1 < len(order) else 0.0
            limits.append(max(0.5, (float(pk[order][ok[-1]]) + below) / 2))
        else:
            limits.append(1.1)
    model.threshold = tuple(limits)
    return model


def covers(c: tuple[int, int, int], spans: list[tuple[int, int, int]]) -> bool:
    """Whether candidate ``c`` agrees with a span of its kind on most of either."""
    for k, a, b in spans:
        shared = min(b, c[2]) - max(a, c[1])
        if k == c[0] and shared > 0 and 2 * shared > max(b - a, c[2] - c[1]):
            return True
    return False


CUE_OF = (3, 2, 1, 0)  # the group of CUES that belongs to each kind
CUE_WORDS = (("mail ", "contact: "), ("host ", "server: "), ("card ", "pay: "), ("phone ", "call ", "tel: "))
AT_DOT = ((" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" {at} ", " {dot} "),
          (" (at) ", "."))


def disguises(kind: int, s: str) -> list[tuple[str, str, bool]]:
    """(cue, form, positive): forms of the base span ``s`` that the base patterns miss."""
    cues, digits = CUE_WORDS[kind], DIGITS.sub("", s)
    if kind == 0:
        local, _, domain = s.partition("@")
        clear = [f"{local}{at}{domain.replace('.', dot)}" for at, dot in AT_DOT]
        forms = [f"{local} @ {domain}"]
    elif kind == 1:
        clear, forms = [], [s.replace(".", ". "), s.replace(".", " .")]
    elif kind == 2:
        fours = [digits[i:i + 4] for i in range(0, len(digits), 4)]
        wrong = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        clear = [sep.join(fours) for sep in ("/", ".", ":", " - ")]
        return [(c, f, True) for f in clear for c in ("", cues[0])] + [
            ("", sep.join([wrong[i:i + 4] for i in range(0, len(wrong), 4)]), False) for sep in ("", "/", ".", "-")]
    else:
        a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
        clear = []
        forms = [s[1:], f"{a}-{b}-{c}", f"{a}/{b}-{c}", f"{a}.{b}.{c}", f"{a} {b}:{c}", f"({a}) {b} {c}", "00" + digits]
    return [("", f, True) for f in clear] + [(c, f, True) for f in forms for c in cues] + [("", f, False) for f in forms]


def drawn(spans: list[tuple], text: str, most: int) -> list[tuple]:
    """At most ``most`` of a document's spans, by the hash of their contents and places."""
    if len(spans) <= most:
        return spans
    return sorted(spans, key=lambda c: hashlib.md5(f"{c} {text[c[1]:c[2]]}".encode("utf-8", "replace")).digest())[:most]


def examples(text: str) -> list[tuple[list[float], float, bool]]:
    """(features, label, held back) of one document, for learning only."""
    def fold(key: str) -> bool:
        return hashlib.md5((key + text).encode("utf-8", "replace")).digest()[0] % 2 == 0

    out = []
    spans = base_spans(text)
    # Of the sample only: a list of numbers must not outweigh all else.  Drawn by hash, wherever they lie.
    for c in drawn(candidates(text), text, CANDIDATES_PER_DOC):
        if not any(c[1] < b and a < c[2] for _, a, b in spans):
            x = features(text, *c)
            if not x[CUE_OF[c[0]] - 4]:
                out.append((x, 0.0, fold("")))
    for kind, a, b in drawn(spans, text, SPANS_PER_DOC):
        held = fold(text[a:b])
        for cue, form, positive in disguises(kind, text[a:b]):
            head = text[max(0, a - 60):a] + cue
            shown = head + form + text[b:b + 60]
            planted = (kind, len(head), len(head) + len(form))
            fixed = base_spans(shown)
            for c in candidates(shown):
                if c[1] >= planted[2] or c[2] <= planted[1] or any(c[1] < q and p < c[2] for _, p, q in fixed):
                    continue
                x = features(shown, *c)
                right = c == planted if kind == 0 else covers(c, [planted])
                if right and not positive and x[CUE_OF[kind] - 4]:
                    continue  # the text before happens to hold a cue
                out.append((x, float(right and positive), held))
    return out


def fit_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS) -> Trees:
    """Learn from the candidates of about ``max_docs`` documents, thinned by a
    hash of the text; the driver fetches their features, never texts."""
    src = docs.select(text_col).where(F.col(text_col).isNotNull())
    share = min(1.0, max_docs / max(1, src.count()))
    some = src.where(F.pmod(F.xxhash64(F.lit("pii"), text_col), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        xs, ys, folds = [], [], []
        for text in batch.column(0).to_pylist():
            for x, y, held in examples(text):
                xs.append(x)
                ys.append(y)
                folds.append(held)
        if not xs:
            return None
        return pa.record_batch([pa.array(xs, pa.list_(pa.float64())), pa.array(ys), pa.array(folds)],
                               ["x", "y", "held"])

    rows = sorted(map(tuple, map_batches(some, run, "x array<double>, y double, held boolean").collect()))
    if not rows:
        return Trees(-30.0, [], (1.1,) * len(KINDS))
    return fit_trees(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))


def is_free(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether ``a`` to ``b`` overlaps none of the sorted, disjoint spans."""
    i = bisect_left(spans, (b,))  # spans from here on begin at b or later
    return i == 0 or spans[i - 1][1] <= a


def select(text: str, base: list[tuple[int, int, int]], model: Trees) -> list[tuple[int, int, int]]:
    """Spans the method adds to the base ones."""
    found = candidates(text)
    if found and base:
        fixed: list[tuple[int, int]] = []  # base spans of different kinds may overlap
        for a, b in sorted((a, b) for _, a, b in base):
            if fixed and a < fixed[-1][1]:
                fixed[-1] = (fixed[-1][0], max(b, fixed[-1][1]))
            else:
                fixed.append((a, b))
        found = [c for c in found if is_free(fixed, c[1], c[2])]
    if not found:
        return []
    p = model.probability(np.array([features(text, *c) for c in found]))
    good = sorted((-p[i], c[1], -c[2], c) for i, c in enumerate(found) if p[i] >= model.threshold[c[0]])
    taken: list[tuple[int, int, int]] = []
    used: list[tuple[int, int]] = []
    for *_, c in good:
        if is_free(used, c[1], c[2]):
            taken.append(c)
            insort(used, (c[1], c[2]))
    return taken


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with ``[KIND]`` in place of the spans (overlaps merge into the first)."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, model: Trees, *, id_col: str = "doc_id", text_col: str = "text",
             redacted: bool = True) -> DataFrame:
    """Base and added spans (arrays of kind, start, end) and the redacted text."""
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bases, adds, texts = [], [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            added = select(text, base, model)
            bases.append([(KINDS[k], a, b) for k, a, b in base])
            adds.append([(KINDS[k], a, b) for k, a, b in added])
            texts.append(redact(text, base + added) if redacted else None)
        as_rows = lambda rows: [[dict(zip(("kind", "start", "stop"), s)) for s in r] for r in rows]
        return pa.record_batch([batch.column(0), pa.array(as_rows(bases), pa.list_(span)),
                                pa.array(as_rows(adds), pa.list_(span)), pa.array(texts, pa.string())],
                               [id_col, "base", "added", "redacted"])

    spans = "array<struct<kind:string,start:bigint,stop:bigint>>"
    return map_batches(docs.select(id_col, text_col), run,
                       f"`{id_col}` {kind}, base {spans}, added {spans}, redacted string")
