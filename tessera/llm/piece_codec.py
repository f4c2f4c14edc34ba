"""SentencePiece encoding and decoding that keeps source offsets.

A model file of a BPE vocabulary (its path is a parameter, nothing is
trained) is read field by field.  Encoding has three steps:

* **Normalisation.**  The compiled character map is a double array of
  rewritten prefixes.  Its keys are read out once; at every place of a text
  the longest key that begins there is rewritten, everything else stays.  Each
  byte of the normalised text keeps the place in the source that it came from.
* **Merging.**  No piece of a vocabulary holds white space after other
  characters, so merges never cross the end of a word: the normalised text is cut before
  white space, and each distinct word of a slice is merged once.  Words are merged
  together, as rows of a matrix: per round, every row merges its best pair.
  Long words go through a queue of pairs instead, in n log n steps.
* **Projection.**  The ends of the pieces in the normalised text, looked up in
  the alignment, are byte spans of the source.  Characters outside the
  vocabulary become byte pieces, the last of which holds the character's span.

Decoding needs the ids only.  A task holds its words within ``CACHE`` bytes and
one slice of texts at a time; a long text is a slice of its own and never cut.

Defined results: null texts are like empty ones, which have the end id only;
repeated rows are encoded one by one; an empty table gives no rows; bytes that
are no UTF-8 read as U+FFFD.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

SPACE = "▁".encode()  # white space in a normalised text
HEAD = b"\xff"  # marks a word that begins without it; no byte of UTF-8
#: Bytes of words and their pieces that a task keeps; two generations of them.
CACHE = 96 << 20
#: Bytes of text whose words are learned and encoded at once.
SLICE = 1 << 20
#: Words of more characters are merged through a queue.
WIDE = 48
#: Rows of the merge matrix.
ROWS = 1 << 14
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of every field of a serialized message."""
    at = 0

    def varint() -> int:
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            if b < 128:
                return x
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at:at + n]
        at += n


def map_entries(blob: bytes) -> dict[str, bytes]:
    """The rewritten prefixes of a compiled character map.

    The blob is the length of a double array of 32-bit units, the units, and
    the replacements, which end in a zero byte each.  A unit holds a label, an
    offset to its children and whether one of them is a value."""
    if not blob:
        return {}
    size = struct.unpack("<I", blob[:4])[0]
    units = np.frombuffer(blob[4:4 + size], "<u4").astype(np.int64)
    texts = blob[4 + size:]
    labels = units & 0x800000FF
    offsets = (units >> 10) << ((units & (1 << 9)) >> 6)
    every = np.arange(1, 256)
    out: dict[str, bytes] = {}
    todo = [(0, b"")]
    while todo:
        node, key = todo.pop()
        base = node ^ int(offsets[node])
        if key and units[node] >> 8 & 1:
            begin = int(units[base] & 0x7FFFFFFF)
            out[key.decode()] = texts[begin:texts.index(b"\0", begin)]
        kids = base ^ every
        inside = kids < len(units)
        for c in every[inside][labels[kids[inside]] == every[inside]].tolist():
            todo.append((base ^ c, key + bytes([c])))
    return out


class Normalizer:
    """Longest-prefix rewriting that records where every byte came from."""

    def __init__(self, blob: bytes, dummy_prefix: bool = True, remove_extra: bool = True, escape: bool = True):
        self.entries = map_entries(blob)
        self.dummy_prefix, self.remove_extra, self.escape = dummy_prefix, remove_extra, escape
        self.longest = max(map(len, self.entries), default=0)
        # Where a key may begin: a character that is one, or two that begin a longer one.
        single = {k for k in self.entries if len(k) == 1}
        pairs: dict[str, set[str]] = {}
        for k in self.entries:
            if len(k) > 1:
                pairs.setdefault(k[1], set()).add(k[0])
        firsts = set().union(*pairs.values()) if pairs else set()
        cls = lambda cs: "[" + "".join(map(re.escape, sorted(cs))) + "]"
        ways = [cls(single)] * bool(single) + [f"{cls(firsts)}(?={cls(pairs)})"] * bool(pairs)
        self.begin = re.compile("|".join(ways)) if ways else None

    def rewrite(self, text: str) -> tuple[bytes, np.ndarray]:
        """The rewritten text and, for each of its bytes and its end, the byte it came from."""
        data = text.encode("utf-8", "replace")
        if self.begin is None or not self.begin.search(text):
            return data, np.arange(len(data) + 1, dtype=np.int32 if len(data) < 1 << 30 else np.int64)
        parts, places = [], []
        done = source = 0  # characters and bytes behind us
        for m in self.begin.finditer(text):
            at = m.start()
            if at < done:
                continue
            key = next((text[at:at + n] for n in range(self.longest, 0, -1) if text[at:at + n] in self.entries), None)
            if key is None:
                continue
            same = text[done:at].encode("utf-8", "replace")
            parts += [same, self.entries[key]]
            places.append(np.arange(source, source + len(same)))
            source += len(same)
            places.append(np.full(len(self.entries[key]), source))
            source += len(key.encode("utf-8", "replace"))
            done = at + len(key)
        parts.append(text[done:].encode("utf-8", "replace"))
        places.append(np.arange(source, len(data) + 1))
        return b"".join(parts), np.concatenate(places)

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised text and, for each of its bytes and its end, the source byte."""
        data, place = self.rewrite(text)
        raw = np.frombuffer(data, np.uint8)
        if self.remove_extra:
            space = raw == 32
            keep = ~space
            keep[1:] |= ~space[:-1]  # the first of several
            full = np.flatnonzero(~space)
            last = int(full[-1]) + 1 if len(full) else 0
            keep[last:] = False
            keep[:1] &= ~space[:1]
            # What is dropped at the end belongs to no piece.
            place = np.r_[place[:-1][keep], place[last]]
            raw = raw[keep]
            data = raw.tobytes()
        if not len(raw):
            return b"", place[-1:]
        mark = SPACE if self.escape else b" "
        if self.escape:
            wide = np.ones(len(raw) + 1, np.int8)
            wide[:-1][raw == 32] = len(SPACE)
            place = np.repeat(place, wide)
            data = data.replace(b" ", SPACE)
        if self.dummy_prefix:
            data = mark + data
            place = np.concatenate([np.full(len(mark), place[0]), place])
        return data, place


class PieceModel:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            message = list(fields(f.read()))
        trainer = dict(fields(next((v for n, v in message if n == 2), b"")))
        spec = dict(fields(next((v for n, v in message if n == 3), b"")))
        if trainer.get(3, 1) != 2 or trainer.get(24, 0):
            raise ValueError(f"{path}: not a BPE model with white space before words")
        self.normalizer = Normalizer(spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))
        if not self.normalizer.escape:
            raise ValueError(f"{path}: white space is not escaped")
        self.unk_surface = trainer.get(44, b" \xe2\x81\x87 ")
        self.fallback = bool(trainer.get(35, 0))
        pieces, scores, kinds = [], [], []
        for n, v in message:
            if n == 1:
                piece = dict(fields(v))
                pieces.append(piece.get(1, b""))
                scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                kinds.append(piece.get(3, NORMAL))
        if USER in kinds or UNUSED in kinds:
            raise ValueError(f"{path}: user-defined and unused pieces are not supported")
        self.size = len(pieces)
        self.unk = kinds.index(UNKNOWN)
        self.eos = pieces.index(b"</s>")
        self.ids = {p.decode(): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == NORMAL}
        self.bytes = [pieces.index(b"<0x%02X>" % b) for b in range(256)] if self.fallback else None
        if any("▁" in p.lstrip("▁") for p in self.ids):
            raise ValueError(f"{path}: pieces with white space after other characters are not supported")
        # What decoding writes for an id, and how long a piece is in the normalised text.
        self.surface = [b"" if k == CONTROL else self.unk_surface if k == UNKNOWN else p.replace(SPACE, b" ")
                        for p, k in zip(pieces, kinds)]
        self.is_byte = np.zeros(self.size, bool)
        if self.fallback:
            for b, i in enumerate(self.bytes):
                self.surface[i], self.is_byte[i] = bytes([b]), True
        self.width = np.array([1 if k == BYTE else len(p) for p, k in zip(pieces, kinds)], np.int64)
        self.digits = [str(i).encode() for i in range(self.size)]
        # The piece of each code point.
        self.by_point = np.full(max((ord(p) for p in self.ids if len(p) == 1), default=0) + 2, -1, np.int64)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.by_point[ord(p)] = i
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        table = {}
        for p, i in self.ids.items():
            for cut in range(1, len(p)):
                left, right = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if left is not None and right is not None:
                    table[left * self.size + right] = (order[scores[i]], i)
        self.pairs = table
        self.kind = np.int16 if self.size < np.iinfo(np.int16).max else np.int32
        self.none = np.iinfo(self.kind).max
        self.slots = PairTable(table, self.kind)
        self.cache = WordCache(self)

    # ------------------------------------------------------------- merging
    def best(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of merging each pair (``none``: no piece)."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -1
        return self.slots.find(key)

    def merge_rows(self, sym: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the words in the rows of ``sym``, ``lens`` symbols each; returns
        the same, merged, with as many columns."""
        out, n_out = np.full_like(sym, -1), lens.copy()
        row = np.arange(len(sym))
        sym = np.c_[sym, np.full(len(sym), -1, sym.dtype)]
        top = sym.shape[1] - 1
        rank, into = self.best(sym[:, :-1].ravel(), sym[:, 1:].ravel())
        rank, into = rank.reshape(-1, top), into.reshape(-1, top)
        while True:
            at = rank.argmin(axis=1)  # the best pair, the first of equal ones
            live = rank[np.arange(len(row)), at] != self.none
            done = ~live
            out[row[done], :top] = sym[done, :top]
            n_out[row[done]] = lens[done]
            if not live.any():
                return out, n_out
            row, sym, rank, into, lens, at = row[live], sym[live], rank[live], into[live], lens[live] - 1, at[live]
            here = np.arange(len(row))
            new = into[here, at]
            top = int(lens.max())
            # Close the gap behind the merged place; rows end in -1, which no pair has.
            behind = np.arange(top + 1) > at[:, None]
            sym = np.where(behind, sym[:, 1:top + 2], sym[:, :top + 1])
            sym[here, at] = new
            behind = np.arange(top) >= at[:, None]
            rank = np.where(behind, rank[:, 1:top + 1], rank[:, :top])
            into = np.where(behind, into[:, 1:top + 1], into[:, :top])
            for side in (0, 1):  # the pairs before and behind it
                p = at - 1 + side
                ok = np.flatnonzero((p >= 0) & (p < lens - 1))
                q = p[ok]
                rank[ok, q], into[ok, q] = self.best(sym[ok, q], sym[ok, q + 1])

    def merge_long(self, sym: list[int]) -> list[int]:
        """The same for one word of any length, by a queue of pairs."""
        n = len(sym)
        nxt, prv = list(range(1, n)) + [-1], list(range(-1, n - 1))
        alive, heap, size, pairs = [True] * n, [], self.size, self.pairs

        def add(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and sym[a] >= 0 and sym[b] >= 0:
                hit = pairs.get(sym[a] * size + sym[b])
                if hit:
                    heapq.heappush(heap, (hit[0], a, b, sym[a], sym[b], hit[1]))

        for i in range(n - 1):
            add(i, i + 1)
        while heap:
            _, a, b, sa, sb, new = heapq.heappop(heap)
            if not (alive[a] and alive[b]) or sym[a] != sa or sym[b] != sb or nxt[a] != b:
                continue
            sym[a], alive[b] = new, False
            nxt[a] = nxt[b]
            if nxt[b] >= 0:
                prv[nxt[b]] = a
            add(prv[a], a)
            add(a, nxt[a])
        return [s for s, ok in zip(sym, alive) if ok]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of normalised words, byte pieces included, as 32-bit integers."""
        points = np.frombuffer(b"".join(words).decode().encode("utf-32-le"), np.uint32)
        known = self.by_point[np.minimum(points, len(self.by_point) - 1)]
        strange = np.flatnonzero(known < 0)  # characters outside the vocabulary never merge
        # Characters per word: its bytes that don't continue one.
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        ends = np.cumsum(raw & 0xC0 != 0x80)[ends - 1]
        lens = np.diff(ends, prepend=0)
        order = np.argsort(lens, kind="stable")
        n_short = int(np.searchsorted(lens[order], WIDE, "right"))
        out: list = [b""] * len(words)
        for a in range(0, n_short, ROWS):
            part = order[a:min(a + ROWS, n_short)]
            n, top = lens[part], int(lens[part[-1]])
            place = np.arange(top)
            inside = place < n[:, None]
            sym = np.full((len(part), top), -1, self.kind)
            sym[inside] = known[((ends[part] - n)[:, None] + place)[inside]]
            sym, n = self.merge_rows(sym, n)
            inside = place < n[:, None]
            flat = sym[inside].astype(np.int32).tobytes()
            stops = (np.cumsum(n) * 4).tolist()
            odd = ((sym < 0) & inside).any(axis=1)
            begin = 0
            for i, stop in zip(part.tolist(), stops):
                out[i] = flat[begin:stop]
                begin = stop
            for k in np.flatnonzero(odd).tolist():
                i = part[k]
                a, b = np.searchsorted(strange, [ends[i] - lens[i], ends[i]])
                out[i] = self.spell(sym[k, :n[k]].tolist(), points[strange[a:b]].tolist())
        for i in order[n_short:].tolist():
            a, b = np.searchsorted(strange, [ends[i] - lens[i], ends[i]])
            out[i] = self.spell(self.merge_long(known[ends[i] - lens[i]:ends[i]].tolist()), points[strange[a:b]].tolist())
        return out

    def spell(self, ids: list[int], strange: list[int]) -> bytes:
        """The ids with the characters outside the vocabulary (-1, their code
        points in order) as byte pieces or as the unknown id."""
        out: list[int] = []
        points = iter(strange)
        for i in ids:
            if i >= 0:
                out.append(i)
            elif self.fallback:
                out += [self.bytes[b] for b in chr(next(points)).encode()]
            elif not out or out[-1] != self.unk:  # unknown characters in a row are one piece
                out.append(self.unk)
        return np.array(out, np.int32).tobytes()

    # ------------------------------------------------------------ encoding
    def words_of(self, data: bytes) -> list[bytes]:
        """The words of a normalised text, less their first white space."""
        parts = data.split(SPACE)
        head = [HEAD + parts[0]] if parts[0] else []
        del parts[0]
        if all(parts):
            return head + parts
        out, run = head, 0
        for w in parts:
            if w:
                out.append(SPACE * run + w if run else w)
                run = 0
            else:
                run += 1
        if run:
            out.append(SPACE * (run - 1))
        return out

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text: ids (without the end id) and the source bytes at which each
        piece starts and stops.  New words of all the texts are merged at once."""
        ready = []
        for text in texts:
            data, place = self.normalizer(text)
            ready.append((data, place, self.words_of(data)))
        self.cache.learn(set().union(*[words for _, _, words in ready]))
        for data, place, words in ready:
            yield self._place(data, place, self.cache.ids_of(words))

    def _place(self, data: bytes, place: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(ids):
            return ids, np.zeros(0, np.int64), np.zeros(0, np.int64)
        width = self.width[ids]
        if not self.fallback and (ids == self.unk).any():
            raise ValueError("spans of unknown pieces need a vocabulary with byte pieces")
        stop = np.cumsum(width)
        begin = stop - width
        # The bytes of a character: all start with it, the last one stops behind it.
        raw = np.flatnonzero(self.is_byte[ids])
        if len(raw):
            lead = np.frombuffer(data, np.uint8)[begin[raw]] & 0xC0 != 0x80
            first = begin[raw][np.maximum.accumulate(np.where(lead, np.arange(len(raw)), 0))]
            last = np.r_[lead[1:], True]
            begin[raw] = first
            stop[raw] = np.where(last, stop[raw], first)
        return ids, place[begin], place[stop]

    def decode(self, ids: list[int]) -> str:
        """The text that the ids stand for."""
        surface = self.surface
        out = b"".join([surface[i] for i in ids])
        try:
            text = out.decode()
        except UnicodeDecodeError:
            text = self._decode_bytes(ids)
        # White space of the first piece that isn't a control id stands for the beginning.
        drop = 0
        if self.normalizer.dummy_prefix or self.normalizer.remove_extra:
            for i in ids:
                if surface[i]:
                    drop += surface[i][:1] == b" " and not self.is_byte[i] and i != self.unk
                    if surface[i] != b" " or self.is_byte[i] or not self.normalizer.remove_extra:
                        break
        return text[drop:]

    def _decode_bytes(self, ids: list[int]) -> str:
        """Decoding where byte pieces don't make whole characters: bytes that
        belong to none are one U+FFFD each."""
        out, run = [], b""
        for i in [*ids, self.eos]:
            if self.is_byte[i]:
                run += self.surface[i]
                continue
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[:n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    n = 1
                run = run[n:]
            out.append(self.surface[i].decode())
        return "".join(out)


class PairTable:
    """Rank and result by pair, found by two hashes without a search: every
    pair lies in its first or in its second place."""

    def __init__(self, pairs: dict[int, tuple[int, int]], kind: type):
        self.kind, self.none = kind, np.iinfo(kind).max
        bits = max(4, (2 * len(pairs)).bit_length())
        rng = np.random.default_rng(5)
        while not self._fill(pairs, bits, rng):
            bits += 1

    def _fill(self, pairs: dict[int, tuple[int, int]], bits: int, rng: np.random.Generator) -> bool:
        self.shift = np.uint64(64 - bits)
        self.salts = rng.integers(1, 1 << 63, 2, dtype=np.uint64) | np.uint64(1)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        first, second = (p.tolist() for p in self._places(keys))
        place_of = {k: (a, b + (1 << bits)) for k, a, b in zip(keys.tolist(), first, second)}
        held: list = [None] * (2 << bits)
        for k in pairs:
            at = place_of[k][0]
            for _ in range(200):  # move whoever lies there to the other place
                k, held[at] = held[at], k
                if k is None:
                    break
                a, b = place_of[k]
                at = b if at == a else a
            else:
                return False
        self.keys = np.array([-2 if k is None else k for k in held], np.int64)
        self.ranks = np.array([self.none if k is None else pairs[k][0] for k in held], self.kind)
        self.merged = np.array([0 if k is None else pairs[k][1] for k in held], self.kind)
        self.half = 1 << bits
        return True

    def _places(self, keys: np.ndarray) -> list[np.ndarray]:
        return [((keys.astype(np.uint64) * salt) >> self.shift).astype(np.int64) for salt in self.salts]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, second = self._places(keys)
        at = np.where(self.keys[first] == keys, first, second + self.half)
        rank = self.ranks[at]
        rank[self.keys[at] != keys] = self.none
        return rank, self.merged[at]


class WordCache:
    """Pieces by word, in two generations: words not met since the younger one
    was begun are forgotten when it is full."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.used = 0

    def learn(self, words: set[bytes]) -> None:
        """Make sure that all ``words`` are in the younger generation."""
        new = words - self.young.keys()
        if not new:
            return
        if self.used > CACHE:
            self.old, self.young, self.used, new = self.young, {}, 0, words
        known = new & self.old.keys()
        for w in known:
            self.young[w] = self.old[w]
        rest = list(new - known)
        full = [w[1:] if w[:1] == HEAD else SPACE + w for w in rest]
        if rest:
            self.young.update(zip(rest, self.model.merge(full)))
        self.used += 5 * sum(map(len, new)) + 200 * len(new)  # a piece takes 4 bytes, at least one of the word's

    def ids_of(self, words: list[bytes]) -> np.ndarray:
        """The pieces of learned words."""
        return np.frombuffer(b"".join(map(self.young.__getitem__, words)), np.int32)


def encode_documents(docs: DataFrame, model_path: str, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, ``ids`` (with the end id) and, per piece, ``starts``
    and ``stops``: the bytes of the source it stands for (the end id: its end)."""

    def rows(model: PieceModel, texts: list[str]) -> list[pa.Array]:
        ids, starts, stops = [], [], []
        for text, (i, a, b) in zip(texts, model.encode(texts)):
            end = len(text.encode("utf-8", "replace"))
            ids.append(np.append(i, np.int32(model.eos)))
            starts.append(np.append(a, end))
            stops.append(np.append(b, end))
        return [pa.array(ids, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int64())),
                pa.array(stops, pa.list_(pa.int64()))]

    return _over_texts(docs, model_path, keep, text_col, rows, "ids array<int>, starts array<bigint>, stops array<bigint>")


def round_trips(docs: DataFrame, model_path: str, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """Digests of what ``encode_documents`` returns and of the decoded ids, made
    where the pieces are, so that no id leaves its task: ``n_tokens``,
    ``ids_sha256``, ``decoded_sha256``, ``spans_sha256`` (starts and stops in
    turn, 8 bytes each) and ``n_source_bytes`` that the pieces' spans cover."""

    def rows(model: PieceModel, texts: list[str]) -> list[pa.Array]:
        out = []
        digits = model.digits
        for i, a, b in model.encode(texts):
            ids = [*i.tolist(), model.eos]
            spans = hashlib.sha256(np.stack([a, b], axis=1).astype("<i8").tobytes()) if len(i) else hashlib.sha256()
            out.append((len(ids), hashlib.sha256(b" ".join([digits[x] for x in ids])).hexdigest(),
                        hashlib.sha256(model.decode(ids).encode()).hexdigest(), spans.hexdigest(), int((b - a).sum())))
        return [pa.array(c) for c in zip(*out)]

    return _over_texts(docs, model_path, keep, text_col, rows, "n_tokens long, ids_sha256 string, decoded_sha256 string, "
                                                               "spans_sha256 string, n_source_bytes long")


def _over_texts(docs: DataFrame, model_path: str, keep: list[str], text_col: str,
                rows: Callable[[PieceModel, list[str]], list[pa.Array]], schema: str) -> DataFrame:
    """Apply ``rows`` to slices of texts; the model is read once per task."""
    src = docs.select(*[F.col(c).alias(f"k{n}") for n, c in enumerate(keep)],
                      F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    kept = ", ".join(f"k{n} {f.dataType.simpleString()}" for n, f in enumerate(src.schema.fields[:-1]))
    names = [s.split()[0] for s in schema.split(", ")]
    made: list[PieceModel] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not made:
            made.append(PieceModel(model_path))
        model, column, at, parts = made[0], batch.column(len(keep)), 0, []
        while at < batch.num_rows:
            texts, size = [], 0
            while at < batch.num_rows and size < SLICE:
                texts.append(column[at].as_py().decode("utf-8", "replace"))
                size += len(texts[-1])
                at += 1
            parts.append(rows(model, texts))
        if not parts:
            return None
        columns = [pa.concat_arrays(list(c)) for c in zip(*parts)]
        return pa.record_batch([*batch.columns[:len(keep)], *columns], [*[f"k{n}" for n in range(len(keep))], *names])

    out = map_batches(src, run, f"{kept}, {schema}" if keep else schema)
    return out.select(*[F.col(f"k{n}").alias(c) for n, c in enumerate(keep)], *names)
