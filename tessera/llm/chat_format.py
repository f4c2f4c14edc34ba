"""Chat formatting: spans of turns found by rendering successive prefixes.

The template is a black box: an object whose ``render(turns)`` turns a list
of (role, text) into one string.  For every turn the operator renders the
turns before it and the same turns with it, and compares the two outputs: if
the first is a prefix of the second, the rest is the span of the turn.  If it
is not, the template rewrites history.  Rendering the turn once more with a
sentinel as its text shows where the text lies inside the span, which gives
the loss mask of assistant turns.

``stream`` mode keeps the first turn and the last ``WINDOW`` turns of a
conversation as context; ``rewrites_history`` decides on probes whether a
template allows that, and a turn that breaks the prefix rule later raises.
Templates that declare ``turn_local = True`` (what a turn adds depends on no
others) need no more, so memory stays bounded however long a conversation is.
With any other template the turns are held, and the output of each whole
conversation is rendered once and compared with its pieces; if they differ,
the operator raises.  Templates
that rewrite history go through ``buffer`` mode: a turn's span starts where
the output of the turns before it stops agreeing with the final output, and
the loss span is found with the sentinel in the whole conversation; a text
that the final output leaves out has none, one that can't be located raises.

``MarkedTemplate`` marks turns and escapes control strings in texts and roles
reversibly: one backslash goes behind the first character of every control
string, and one more where a backslash is there already.

Defined results: null role or text counts as empty; rows of equal turn number
follow in order of role, then text, and repeated rows are turns of their own;
rows without conversation id form one conversation without id; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 4
SENTINEL = "\x01"
Turn = tuple[str, str]


class MarkedTemplate:
    """``<|im_start|>role\\ntext<|im_end|>\\n`` per turn."""

    turn_local = True
    START, END = "<|im_start|>", "<|im_end|>"
    CONTROLS = (START, END, "<s>", "</s>", "[INST]", "[/INST]")
    _rest = "|".join(re.escape(c[1:]) for c in CONTROLS if c[0] == "<")
    _rest2 = "|".join(re.escape(c[1:]) for c in CONTROLS if c[0] == "[")
    # No control string holds the first character of another one inside, so matches never overlap.
    _PLAIN = re.compile(rf"(<)(\\*)({_rest})|(\[)(\\*)({_rest2})")
    _ESCAPED = re.compile(rf"(<)(\\*)\\({_rest})|(\[)(\\*)\\({_rest2})")
    _TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)

    @classmethod
    def escape(cls, s: str) -> str:
        if "<" not in s and "[" not in s:
            return s
        return cls._PLAIN.sub(lambda m: (m[1] or m[4]) + (m[2] or m[5] or "") + "\\" + (m[3] or m[6]), s)

    @classmethod
    def unescape(cls, s: str) -> str:
        if "\\" not in s:
            return s
        return cls._ESCAPED.sub(lambda m: (m[1] or m[4]) + (m[2] or m[5] or "") + (m[3] or m[6]), s)

    @classmethod
    def role_out(cls, s: str) -> str:
        return cls.escape(s).replace("%", "%25").replace("\n", "%0A")

    @classmethod
    def role_in(cls, s: str) -> str:
        return cls.unescape(s.replace("%0A", "\n").replace("%25", "%"))

    def render(self, turns: list[Turn]) -> str:
        return "".join(f"{self.START}{self.role_out(r)}\n{self.escape(t)}{self.END}\n" for r, t in turns)

    def parse(self, buffer: str) -> tuple[list[Turn], str]:
        """Complete turns at the start of ``buffer`` and what is left of it."""
        turns, at = [], 0
        while m := self._TURN.match(buffer, at):
            turns.append((self.role_in(m[1]), self.unescape(m[2])))
            at = m.end()
        return turns, buffer[at:]


def common_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


def text_place(template, context: list[Turn], turn: Turn, prev: str, piece: str) -> tuple[int, int] | None:
    """Where the text of ``turn`` lies inside its ``piece``."""
    marked = template.render([*context, (turn[0], SENTINEL)])[len(prev):]
    head, mark, tail = marked.partition(SENTINEL)
    if not mark or not piece.startswith(head) or not piece.endswith(tail) or len(head) + len(tail) > len(piece):
        return None
    return len(head), len(piece) - len(tail)


def first_rewrite(template, turns: list[Turn]) -> int | None:
    """Index of the first turn whose rendering changes the output before it
    or depends on more than the first and the last ``WINDOW`` turns."""
    prev, pieces = "", []
    for k in range(len(turns)):
        cur = template.render(turns[:k + 1])
        if not cur.startswith(prev):
            return k
        piece = cur[len(prev):]
        if k > WINDOW:
            context = [turns[0], *turns[k - WINDOW + 1:k]]
            if template.render([*context, turns[k]])[len(template.render(context)):] != piece:
                return k
        pieces.append(piece)
        prev = cur
    return None


def rewrites_history(template) -> bool:
    """Probe conversations: plain, with a system turn, long, with odd texts."""
    long = [("user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(3 * WINDOW)]
    probes = [long, [("system", "be brief"), *long], [("user", ""), ("assistant", " x "), ("user", "\n")],
              [("assistant", "a"), ("assistant", "b"), ("system", "c"), ("user", "d")]]
    return any(first_rewrite(template, p) is not None for p in probes)


def buffered_spans(template, turns: list[Turn]) -> list[tuple[int, int]]:
    """Spans in the final output, for templates that rewrite history."""
    final = template.render(turns)
    starts = [0] if turns else []
    for k in range(1, len(turns)):
        starts.append(max(starts[-1], common_prefix(template.render(turns[:k]), final)))
    return list(zip(starts, [*starts[1:], len(final)]))


def buffered_loss(template, turns: list[Turn], k: int, final: str) -> tuple[int | None, int | None]:
    """Where the text of turn ``k`` lies in the final output; None if it isn't part of it."""
    marked = template.render([*turns[:k], (turns[k][0], SENTINEL), *turns[k + 1:]])
    head, mark, tail = marked.partition(SENTINEL)
    if not mark and marked == final:
        return None, None
    if not mark or not final.startswith(head) or not final.endswith(tail) or len(head) + len(tail) > len(final):
        raise ValueError(f"turn {k}: its text can't be located in the output")
    return len(head), len(final) - len(tail)


class _Conversation:
    """Turns of one conversation as they arrive, with bounded context."""

    def __init__(self, template):
        self.template, self.n, self.offset = template, 0, 0
        self.context: list[Turn] = []
        self.prev = ""

    def add(self, turn: Turn) -> tuple[int, int, int, int | None, int | None, str]:
        cur = self.template.render([*self.context, turn])
        if not cur.startswith(self.prev):
            raise ValueError(f"turn {self.n}: the template rewrites history; use mode='buffer'")
        piece = cur[len(self.prev):]
        loss = (None, None)
        if turn[0] == "assistant":
            place = text_place(self.template, self.context, turn, self.prev, piece)
            if place is None:
                raise ValueError(f"turn {self.n}: its text can't be located in the output")
            loss = (self.offset + place[0], self.offset + place[1])
        row = (self.n, self.offset, self.offset + len(piece), *loss, piece)
        self.n += 1
        self.offset += len(piece)
        if self.n <= WINDOW:
            self.context, self.prev = [*self.context, turn], cur
        else:
            self.context = [self.context[0], *self.context[2:], turn]
            self.prev = self.template.render(self.context)
        return row


PIECES = "pos long, role string, start long, stop long, loss_start long, loss_stop long, piece string"


def format_chats(rows: DataFrame, template, *, mode: str = "stream", conv_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conversation id, position, role, span in the formatted
    output (code points), span of the loss mask, and the piece of output.

    Conversations are dealt out by id and sorted inside their partitions; the
    pieces of a conversation come in order from one task."""
    if mode == "stream" and rewrites_history(template):
        raise ValueError("the template rewrites history; use mode='buffer'")
    src = rows.select(F.col(conv_col), F.col(turn_col), F.coalesce(role_col, F.lit("")).alias("_r"),
                      F.coalesce(text_col, F.lit("")).alias("_t"))
    src = src.repartition(F.col(conv_col)).sortWithinPartitions(conv_col, turn_col, "_r", "_t")
    kind = src.schema[conv_col].dataType.simpleString()
    fields = [conv_col, *(f.split()[0] for f in PIECES.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, conv, held, made = object(), None, [], []
        whole = mode == "stream" and not getattr(template, "turn_local", False)

        def flush(out):
            if mode == "buffer" and held:
                final = template.render(held)
                for k, (a, b) in enumerate(buffered_spans(template, held)):
                    loss = (None, None)
                    if held[k][0] == "assistant":
                        loss = buffered_loss(template, held, k, final)
                    out.append((current, k, held[k][0], a, b, *loss, final[a:b]))
            elif held and template.render(held) != "".join(made):
                raise ValueError("the template rewrites history; use mode='buffer'")
            held.clear()
            made.clear()

        for batch in batches:
            out: list[tuple] = []
            ids, roles, texts = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for cid, role, text in zip(ids, roles, texts):
                if cid != current:
                    flush(out)
                    current, conv = cid, _Conversation(template)
                if mode == "buffer":
                    held.append((role, text))
                else:
                    n, a, b, la, lb, piece = conv.add((role, text))
                    out.append((cid, n, role, a, b, la, lb, piece))
                    if whole:
                        held.append((role, text))
                        made.append(piece)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), types(batch.column(0).type))], fields)
        out = []
        flush(out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types(None))], fields)

    def types(first):
        long, text = pa.int64(), pa.string()
        return [first or (pa.int64() if kind in ("bigint", "int") else pa.string()), long, text, long, long, long,
                long, text]

    return src.mapInArrow(run, f"`{conv_col}` {kind}, {PIECES}")


def read_back(pieces: DataFrame, template: MarkedTemplate, *, conv_col: str = "conv_id") -> DataFrame:
    """Digests per conversation, parsed from the formatted output alone.

    ``pieces`` must come straight from ``format_chats`` (each conversation
    whole and in order in one partition); the state per conversation is two
    hashes, three counts and at most one unfinished turn."""
    kind = pieces.schema[conv_col].dataType.simpleString()
    names = [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def done(s, out):
            if s is not None:
                if s["left"]:
                    raise ValueError(f"conversation {s['id']}: the output doesn't end with a turn")
                out.append((s["id"], s["n"], s["all"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["total"]))

        def batch_of(out, first):
            kinds = [first, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

        first = None
        for batch in batches:
            out: list[tuple] = []
            first = batch.column(0).type
            for cid, a, la, lb, piece in zip(*(batch.column(i).to_pylist() for i in (0, 3, 5, 6, 7))):
                if state is None or cid != state["id"]:
                    done(state, out)
                    state = {"id": cid, "n": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0,
                             "total": 0, "left": ""}
                turns, state["left"] = template.parse(state["left"] + piece)
                for role, text in turns:
                    state["all"].update(f"{role}\n{text}\n".encode())
                state["n"] += len(turns)
                if la is not None:
                    text = template.unescape(piece[la - a:lb - a])
                    state["loss"].update(text.encode())
                    state["chars"] += len(text)
                state["total"] += len(piece)
            if out:
                yield batch_of(out, first)
        out = []
        done(state, out)
        if out:
            yield batch_of(out, first)

    return pieces.mapInArrow(run, f"`{conv_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                                  "loss_sha256 string, formatted_chars long")
