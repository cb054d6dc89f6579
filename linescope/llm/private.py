"""Personal data in texts: patterns, and a linear-chain conditional random field over word shapes.

Four patterns (mail address, IP address, card number, phone number) give the base spans. The field finds further forms
of the same kinds: it labels tokens (letter runs, digit runs, single marks) as outside, beginning or inside a kind. A
token is seen as its shape, never as itself, with the shapes around it, pairs of neighbouring shapes, the gap before it
and whether the digits it belongs to pass the check sum. Weights come from gradient steps on the likelihood of the small
table of :mod:`private_table`; the best labelling of all chains of a slice is found at once, token by token, by Viterbi.

Only tokens near a trigger (a digit, an at-sign, a spelled "at" or "dot") can belong to a span: tokens further than
``REACH`` from every trigger are outside by definition and are not decoded. What the field adds must not overlap a base
span and must pass the plain rules of its kind (:func:`valid`).

A row is one text, so nothing is shuffled; memory follows the longest text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from linescope.llm.private_table import labelled, passes_luhn
from linescope.llm.words import slices

KINDS = ["email", "ip", "card", "phone"]
# --- fixed values: the base patterns of the contract, in pieces that read every text once ---
_MAIL_HOST = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(rb"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
# --------------------------------------------------------------------------------------------
_NAME_BYTES = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(rb"[0-9]+")
#: Digits in any grouping, for the check-sum feature.
_GROUPED = re.compile(rb"[0-9](?:[\x20._/-]{0,2}[0-9])+")

REACH = 6
SIDE = 3
#: Words that are shapes of their own.
CUES = "at dot mail email e write contact reach tel phone call fax mobile ip host server login address card visa account paid number isbn token page".split()
ITERATIONS, RATE, PENALTY = 60, 0.25, 0.02

LABELS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
_BEGIN = {k: LABELS.index(f"B-{k}") for k in KINDS}
_NEVER = -1e9


def _allowed() -> np.ndarray:
    """Transitions, the last row from the start: inside only behind its own kind."""
    out = np.zeros((len(LABELS) + 1, len(LABELS)))
    for k in KINDS:
        b = _BEGIN[k]
        out[:, b + 1] = _NEVER
        out[[b, b + 1], b + 1] = 0
    return out


# --- base spans -----------------------------------------------------------------------------


def _digits(found: bytes) -> str:
    return b"".join(_DIGITS.findall(found)).decode()


def mails(text: bytes) -> Iterator[tuple[int, int]]:
    """The name in front of an at-sign is the whole stretch of name characters, so each is read once."""
    free, at = 0, text.find(b"@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _NAME_BYTES:
            start -= 1
        host = _MAIL_HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            free = host.end()
        at = text.find(b"@", max(at + 1, free))


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the patterns by start, then kind; byte places."""
    out = [(s, e, 0) for s, e in mails(text)]
    for m in _DOTTED.finditer(text):
        groups = list(_DIGITS.finditer(m.group()))
        for i in range(0, len(groups) - 3, 4):  # four numbers are a match, the next begins behind it
            four = groups[i : i + 4]
            if all(len(g.group().lstrip(b"0")) <= 3 and int(g.group()[-4:]) <= 255 for g in four):
                out.append((m.start() + four[0].start(), m.start() + four[3].end(), 1))
    for m in _CARD.finditer(text):
        found = _digits(m.group())
        if 12 <= len(found) <= 19 and passes_luhn(found):
            out.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def valid(kind: int, found: bytes) -> bool:
    """Plain rules for a span that the field adds."""
    numbers = _DIGITS.findall(found)
    digits = b"".join(numbers).decode()
    if kind == 0:
        return b"@" in found or re.search(rb"(?i)(?<![A-Za-z])at(?![A-Za-z])", found) is not None
    if kind == 1:
        return len(numbers) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in numbers)
    if kind == 2:
        return 12 <= len(digits) <= 19 and passes_luhn(digits)
    return 7 <= len(digits) <= 15


# --- tokens and features --------------------------------------------------------------------

_CLASS = np.full(256, 3, np.int8)  # marks
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[ord("A") : ord("Z") + 1] = _CLASS[ord("a") : ord("z") + 1] = _CLASS[0x80:] = 1
_CLASS[ord("0") : ord("9") + 1] = 2


def shape(token: bytes) -> str:
    first = token[0]
    if 0x30 <= first <= 0x39:
        return f"d{min(len(token), 20)}"
    if _CLASS[first] == 3:
        return chr(first)
    low = token.lower().decode("utf-8", "replace")
    if low in CUES:
        return low
    upper = sum(0x41 <= b <= 0x5A for b in token)
    case = "x" if not upper else "X" if upper == len(token) else "Xx" if upper == 1 and 0x41 <= first <= 0x5A else "xX"
    return case + ("1" if len(token) == 1 else "3" if len(token) <= 3 else "9")


class Tokens:
    """Tokens of a slice of texts, with the feature numbers of those near a trigger.

    ``place`` holds their places among all tokens; chains are stretches of neighbouring ones in a row.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, known: dict[str, int]) -> None:
        kind = _CLASS[data]
        n = len(data)
        cut = np.zeros(n + 1, bool)
        cut[at] = True
        begin = kind != 0
        begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 3) | cut[1:n]
        self.starts = np.flatnonzero(begin)
        stop = kind != 0
        stop[:-1] &= (kind[1:] != kind[:-1]) | (kind[:-1] == 3) | cut[1:n]
        self.ends = np.flatnonzero(stop) + 1
        first = np.searchsorted(self.starts, at)
        row = np.repeat(np.arange(len(at) - 1), np.diff(first))
        lead = data[self.starts] if n else np.zeros(0, np.uint8)
        trigger = (_CLASS[lead] == 2) | (lead == ord("@")) | self._spelled(data)
        near = self._near(trigger, row, REACH)
        self.place = np.flatnonzero(near)
        m = len(self.place)
        self.row = row[self.place]
        # Shapes are needed around the decoded tokens, too.
        around = np.flatnonzero(self._near(near, row, SIDE))
        number = np.zeros(len(self.starts) + 1, np.int64)
        memo: dict[bytes, int] = {}
        raw = data.tobytes()
        for t in around.tolist():
            token = raw[self.starts[t] : self.ends[t]]
            found = memo.get(token)
            if found is None:
                found = memo[token] = known.get(shape(token), 1)
            number[t] = found
        gap = np.zeros(len(self.starts) + 1, np.int64)
        if m:
            space = np.zeros(len(self.starts), np.int64)
            space[1:] = self.starts[1:] - self.ends[:-1]
            gap[:-1] = np.minimum(space, 2)
        sums = self._sums(raw, at)
        columns = []
        for o in range(-SIDE, SIDE + 1):
            other = self.place + o
            there = (other >= 0) & (other < len(self.starts))
            other = np.where(there, other, 0)
            there &= row[other] == self.row if m else there
            columns.append((np.where(there, number[other], 0), np.where(there, gap[other], 0)))
        self.columns = columns
        self.sums = sums[self.place]
        self.chain = np.zeros(m, np.int64)
        if m:
            fresh = np.ones(m, bool)
            fresh[1:] = (self.place[1:] != self.place[:-1] + 1) | (self.row[1:] != self.row[:-1])
            self.chain = np.cumsum(fresh) - 1

    def _spelled(self, data: np.ndarray) -> np.ndarray:
        size = self.ends - self.starts
        out = np.zeros(len(self.starts), bool)
        for word in (b"at", b"dot"):
            same = size == len(word)
            for i, b in enumerate(word):
                at = np.minimum(self.starts + i, max(len(data) - 1, 0))
                same &= (data[at] | 0x20) == b if len(data) else same
            out |= same
        return out

    @staticmethod
    def _near(marked: np.ndarray, row: np.ndarray, reach: int) -> np.ndarray:
        out = marked.copy()
        for o in range(1, reach + 1):
            same = row[o:] == row[:-o]
            out[o:] |= marked[:-o] & same
            out[:-o] |= marked[o:] & same
        return out

    def _sums(self, raw: bytes, at: np.ndarray) -> np.ndarray:
        """1 for tokens in 12 to 19 digits that pass the check sum, 2 for those that fail it."""
        out = np.zeros(len(self.starts), np.int64)
        if not len(self.place):
            return out
        for r in np.unique(self.row).tolist():
            for m in _GROUPED.finditer(raw, at[r], at[r + 1]):
                digits = _digits(m.group())
                if 12 <= len(digits) <= 19:
                    a, b = np.searchsorted(self.starts, [m.start(), m.end()])
                    out[a:b] = 1 if passes_luhn(digits) else 2
        return out

    def features(self, n_shapes: int) -> np.ndarray:
        """(tokens, families) numbers into one table of weights."""
        shapes = [c[0] for c in self.columns]
        gaps = [c[1] for c in self.columns]
        out, base = [], 0

        def add(values: np.ndarray, size: int) -> None:
            nonlocal base
            out.append(values + base)
            base += size

        for s in shapes:
            add(s, n_shapes)
        here = SIDE
        for o in (-1, 0, 1):
            pair = shapes[here + o] * n_shapes + shapes[here + o + 1]
            add(pair * 3 + gaps[here + o + 1], 3 * n_shapes**2)
        add(gaps[here] * 3 + gaps[here + 1], 9)
        add(self.sums, 3)
        return np.column_stack(out)


# --- the field ------------------------------------------------------------------------------


class Field:
    """Weights of shapes and transitions."""

    def __init__(self, known: dict[str, int], weights: np.ndarray, moves: np.ndarray) -> None:
        self.known, self.weights, self.moves = known, weights, moves

    @property
    def n_shapes(self) -> int:
        return len(self.known) + 2

    def scores(self, tokens: Tokens) -> np.ndarray:
        made = tokens.features(self.n_shapes)
        out = np.zeros((len(made), len(LABELS)))
        for c in range(made.shape[1]):
            out += self.weights[made[:, c]]
        return out

    def decode(self, tokens: Tokens) -> np.ndarray:
        """Label of every decoded token."""
        return viterbi(self.scores(tokens), tokens.chain, self.moves)


def viterbi(scores: np.ndarray, chain: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels of all chains (ascending numbers, rows together); ``moves`` has the start as its last row.

    Chains take their steps together, longest first, so that the ones still running are a prefix. On equal scores the
    smaller label wins.
    """
    n = len(scores)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    begin = np.flatnonzero(np.append(True, chain[1:] != chain[:-1]))
    size = np.diff(np.append(begin, n))
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    running = np.searchsorted(-size, -np.arange(size[0]), "left")  # chains longer than t
    back = np.zeros((n, scores.shape[1]), np.int8)
    best = scores[begin] + moves[-1]
    final = np.zeros((len(begin), scores.shape[1]))
    for t in range(1, int(size[0])):
        m = int(running[t])
        final[m : len(best)] = best[m:]
        every = best[:m, :, None] + moves[None, :-1]
        back[begin[:m] + t] = every.argmax(axis=1)
        best = every.max(axis=1) + scores[begin[:m] + t]
    final[: len(best)] = best
    label = final.argmax(axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        m = int(running[t])
        at = begin[:m] + t
        out[at] = label[:m]
        label[:m] = back[at, label[:m]]
    return out


def _gradient(scores: np.ndarray, moves: np.ndarray, size: np.ndarray, truth: np.ndarray):
    """Log likelihood of padded chains and its gradients by scores and moves."""
    chains, steps, k = scores.shape
    alpha = np.full((chains, steps, k), _NEVER)
    beta = np.zeros((chains, steps, k))
    running = np.arange(steps)[None, :] < size[:, None]

    def total(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    alpha[:, 0] = scores[:, 0] + moves[-1]
    for t in range(1, steps):
        step = total(alpha[:, t - 1, :, None] + moves[None, :-1], 1) + scores[:, t]
        alpha[:, t] = np.where(running[:, t, None], step, alpha[:, t - 1])
    whole = total(alpha[:, -1], 1)
    grad_moves = np.zeros_like(moves)
    for t in range(steps - 1, 0, -1):
        on = running[:, t]
        ahead = scores[:, t] + beta[:, t]
        pair = alpha[:, t - 1, :, None] + moves[None, :-1] + ahead[:, None, :] - whole[:, None, None]
        grad_moves[:-1] -= np.exp(pair[on]).sum(axis=0)
        beta[:, t - 1] = np.where(on[:, None], total(moves[None, :-1] + ahead[:, None, :], 2), 0.0)
    seen = np.exp(alpha + beta - whole[:, None, None]) * running[:, :, None]
    # Beyond its end a chain repeats its last alpha; beta is 0 there and at the end.
    grad = -seen
    c, t = np.nonzero(running)
    grad[c, t, truth[c, t]] += 1
    grad_moves[-1] -= seen[:, 0].sum(axis=0)
    np.add.at(grad_moves[-1], truth[:, 0], 1)
    later = running[:, 1:]
    c, t = np.nonzero(later)
    np.add.at(grad_moves, (truth[c, t], truth[c, t + 1]), 1)
    return grad, grad_moves


def _train(rows: list[tuple[str, list[tuple[str, int, int]]]]) -> Field:
    texts = [t.encode() for t, _ in rows]
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    plain = Tokens(data, at, {})
    raw = data.tobytes()
    names = sorted({shape(raw[s:e]) for s, e in zip(plain.starts.tolist(), plain.ends.tolist(), strict=True)})
    known = {s: i + 2 for i, s in enumerate(names)}  # 0 is no token, 1 an unknown shape
    tokens = Tokens(data, at, known)
    truth = np.zeros(len(plain.starts), np.int64)
    for i, (text, spans) in enumerate(rows):
        for kind, s, e in spans:
            a, b = (at[i] + len(text[:x].encode()) for x in (s, e))
            inside = np.flatnonzero((tokens.starts >= a) & (tokens.starts < b))
            truth[inside] = _BEGIN[kind] + 1
            truth[inside[0]] = _BEGIN[kind]
    truth = truth[tokens.place]
    made = tokens.features(len(known) + 2)
    used, local = np.unique(made, return_inverse=True)
    local = local.reshape(made.shape)
    n_chains = int(tokens.chain[-1]) + 1
    size = np.bincount(tokens.chain, minlength=n_chains)
    step = np.arange(len(made)) - np.repeat(np.cumsum(size) - size, size)
    shape_ = (n_chains, int(size.max()))
    wanted = np.zeros(shape_, np.int64)
    wanted[tokens.chain, step] = truth
    k, allowed = len(LABELS), _allowed()
    # Tokens by feature: one sum for each feature's stretch.
    order = np.argsort(local.ravel(), kind="stable")
    holder, cuts = order // local.shape[1], np.searchsorted(local.ravel()[order], np.arange(len(used)))
    weights, moves = np.zeros((len(used), k)), np.zeros((k + 1, k))
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    for i in range(1, ITERATIONS + 1):
        scores = np.zeros((*shape_, k))
        scores[tokens.chain, step] = weights[local].sum(axis=1)
        grad, grad_moves = _gradient(scores, moves + allowed, size, wanted)
        grad_weights = np.add.reduceat(grad[tokens.chain, step][holder], cuts)
        for x, g, (a, b) in ((weights, grad_weights, (0, 1)), (moves, grad_moves, (2, 3))):
            g = g - PENALTY * x
            state[a] = 0.9 * state[a] + 0.1 * g
            state[b] = 0.99 * state[b] + 0.01 * g * g
            x += RATE * (state[a] / (1 - 0.9**i)) / (np.sqrt(state[b] / (1 - 0.99**i)) + 1e-8)
    whole = np.zeros((int(sum([(2 * SIDE + 1) * (len(known) + 2), 9 * (len(known) + 2) ** 2, 9, 3])), k), np.float32)
    whole[used] = weights
    return Field(known, whole, moves + allowed)


@lru_cache(maxsize=4)
def train(seed: int = 1) -> Field:
    """The field of the labelled table; the same seed gives the same weights."""
    return _train(labelled(seed))


def added_spans(field: Field, data: np.ndarray, at: np.ndarray, base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Spans of the field for every row, without those that overlap a base span or break the rules of their kind."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in base]
    tokens = Tokens(data, at, field.known)
    if not len(tokens.place):
        return out
    label = field.decode(tokens)
    begins = np.flatnonzero((label > 0) & (label % 2 == 1))
    raw = data.tobytes()
    for b in begins.tolist():
        e = b
        while e + 1 < len(label) and label[e + 1] == label[b] + 1 and tokens.chain[e + 1] == tokens.chain[b]:
            e += 1
        row, kind = int(tokens.row[b]), int(label[b] - 1) // 2
        start, end = int(tokens.starts[tokens.place[b]]), int(tokens.ends[tokens.place[e]])
        s, t = start - int(at[row]), end - int(at[row])
        if valid(kind, raw[start:end]) and not any(x < t and s < y for x, y, _ in base[row]):
            out[row].append((s, t, kind))
    return out


def _rows(sent, at_column: int):
    one = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*sent.value)
        for batch in batches:
            for begin, end, data, at in slices(batch.column(at_column)):
                raw = data.tobytes()
                base = [base_spans(raw[at[i] : at[i + 1]]) for i in range(end - begin)]
                more = added_spans(field, data, at, base)
                # Code points before a byte: those bytes that do not continue one.
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                lists = []
                for i, (own, new) in enumerate(zip(base, more, strict=True)):
                    every = sorted([*((s, k, e, True) for s, e, k in own), *((s, k, e, False) for s, e, k in new)])
                    first = int(points[at[i]])
                    lists.append(
                        [
                            {"kind": KINDS[k], "start": int(points[at[i] + s]) - first, "end": int(points[at[i] + e]) - first, "base": known}
                            for s, k, e, known in every
                        ]
                    )
                part = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lists, pa.list_(one))], [*batch.schema.names, "_spans"])

    return run


def find(docs: DataFrame, text: str = "text", spans: str = "spans", field: Field | None = None) -> DataFrame:
    """``docs`` with one more column: an array of (kind, start, end, base) by start, then kind as in ``KINDS``.

    Places count code points, ends are exclusive; ``base`` tells the spans of the patterns from those that the field
    adds. A null or empty text has no spans. Rows are judged alone: repeated rows and null keys change nothing, an empty
    table gives an empty table. A column of ``docs`` that has the name of the added one is replaced; others may have any
    name.
    """
    kept = [c for c in docs.columns if c != spans or c == text]
    names = [f"c{i}" for i in range(len(kept))]
    held = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)])
    parts = [("kind", StringType()), ("start", LongType()), ("end", LongType()), ("base", BooleanType())]
    one = StructType([StructField(n, t, False) for n, t in parts])
    schema = StructType([*held.schema.fields, StructField("_spans", ArrayType(one, False))])
    made = field or train()
    sent = docs.sparkSession.sparkContext.broadcast((made.known, made.weights, made.moves))
    out = held.mapInArrow(_rows(sent, kept.index(text)), schema)
    back = [F.col(n).alias(c) for c, n in zip(kept, names, strict=True) if c != spans]
    return out.select(*back, F.col("_spans").alias(spans))
