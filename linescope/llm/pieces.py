"""SentencePiece encoding and decoding over the piece lattice, with N-best segmentation.

The lattice of a text has an edge for every vocabulary piece in it, and for a character without a piece one edge of its
UTF-8 bytes. A forward Viterbi pass gives the best score of every prefix; these scores are exact heuristics for a
backward A* search, which pops whole segmentations in descending order of their score.

No piece crosses from another character to a space mark or holds a line end, so the lattice falls apart into segments
(checked when the vocabulary is loaded). The best segmentation of a text joins the best of its segments, and its N best
differ in the N - 1 segments that lose least.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescope.llm.words import slices

#: Where the vocabulary of the registered query is found.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NBEST = 4
#: Distance of a fallback byte below the lowest ranked piece. Pieces that the vocabulary gives no rank (at ``UNRANKED``,
#: among them the lone space mark) score like such a byte.
BYTE_PENALTY = 10.0
UNRANKED = -1e9
#: Segments that a worker remembers.
REMEMBERED = 300_000
#: Bytes of text whose new segments are taken in together.
SLICE = 1 << 22
SEGMENT = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


@dataclass
class Vocabulary:
    """Pieces with scores and ids, fallback bytes, and the bytes that each id stands for."""

    scores: dict[str, tuple[float, int]]
    bytes_: list[int]
    byte_score: float
    text: list[bytes]
    longest: int
    ends: dict[str, tuple[float, int] | None]  # pieces, and None for what only ends one

    @staticmethod
    def load(path: str) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        scores, bytes_, text = {}, [-1] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                bytes_[value] = i
                text.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                text.append(b"")
            else:
                text.append(piece.replace(MARK, " ").encode())
                scores[piece] = (model.get_score(i), i)
        if -1 in bytes_:
            raise ValueError("the vocabulary has no piece for every byte")
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in scores):
            raise ValueError("a piece crosses segments")
        last = min(s for s, _ in scores.values() if s > UNRANKED) - BYTE_PENALTY
        scores = {p: (max(s, last), i) for p, (s, i) in scores.items()}
        ends = dict.fromkeys(p[i:] for p in scores for i in range(1, len(p)))
        return Vocabulary(scores, bytes_, last, text, max(map(len, scores)), ends | scores)

    def edge(self, span: str, literal: bool = False) -> tuple[float, tuple[int, ...]] | None:
        """(score, ids) of the lattice edge over ``span``; ``literal``: a space mark stands for itself."""
        if not literal:
            found = self.scores.get(span)
            if found:
                return found[0], (found[1],)
        if len(span) == 1:
            raw = span.encode()
            return self.byte_score * len(raw), tuple(self.bytes_[b] for b in raw)
        return None

    def decode(self, ids) -> str:
        """The text of the ids; the space that encoding puts first is taken off."""
        return b"".join(self.text[i] for i in ids)[1:].decode("utf-8", "replace")


def _literal(segment: str) -> bool:
    return segment.startswith("\0" + MARK)


def segments(text: str) -> list[str]:
    """Independent parts of the marked text. A mark that the text holds itself is a segment of its own."""
    if not text:
        return []
    if MARK in text:
        out: list[str] = []
        for i, part in enumerate(text.split(MARK)):
            if i:
                out.append("\0" + MARK)
                out += SEGMENT.findall(part.replace(" ", MARK))
            else:
                out += SEGMENT.findall(MARK + part.replace(" ", MARK))
        return out
    return SEGMENT.findall(MARK + text.replace(" ", MARK))


def _extend(segment: str, best: list, second: list, back: list, vocabulary: Vocabulary) -> None:
    """Go on with the forward pass: the lists hold the prefixes of ``segment`` that are done."""
    get = vocabulary.ends.get
    for i in range(len(best), len(segment) + 1):
        found = get(segment[i - 1], 0)
        score, ids = found or vocabulary.edge(segment[i - 1])
        top, next_, link = best[i - 1] + score, second[i - 1] + score, (i - 1, ids)
        if found != 0:
            for j in range(i - 2, -1, -1):
                found = get(segment[j:i], 0)
                if not found:
                    if found is None:
                        continue  # the end of a longer piece
                    break
                score, ids = found
                value = best[j] + score
                if value >= top:
                    top, next_, link = value, top, (j, ids)
                elif value > next_:
                    next_ = value
                value = second[j] + score
                if value > next_:
                    next_ = value
        best.append(top)
        second.append(next_)
        back.append(link)


def _best_ids(back: list) -> tuple[int, ...]:
    ids: list[int] = []
    i = len(back) - 1
    while i:
        i, edge = back[i]
        if isinstance(edge, tuple):
            ids.extend(reversed(edge))
        else:
            ids.append(edge)
    ids.reverse()
    return tuple(ids)


def forward(segment: str, vocabulary: Vocabulary) -> tuple[list[float], float, tuple[int, ...]]:
    """(best score of every prefix, second-best score of the whole, ids of the best)."""
    if _literal(segment):
        score, ids = vocabulary.edge(MARK, True)
        return [0.0, score], -np.inf, ids
    best, second, back = [0.0], [-np.inf], [None]
    _extend(segment, best, second, back, vocabulary)
    return best, second[-1], _best_ids(back)


def nbest(segment: str, vocabulary: Vocabulary, n: int = NBEST) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` best segmentations in descending order, by backward A* search over the lattice."""
    best, _, ids = forward(segment, vocabulary)
    if _literal(segment):
        return [(best[-1], ids)]
    # A state is a place and the trail of pieces behind it. A place is left at most n times: its later, longer ways are in
    # none of the n best. On equal scores the trail that has come further goes first.
    size, count = len(segment), 0
    left = [n] * (size + 1)
    heap = [(-best[size], size, 0, 0.0, None)]
    out = []
    while heap and len(out) < n:
        _, i, _, done, trail = heapq.heappop(heap)
        if not i:
            out.append((done, _ids(trail)))
            continue
        if not left[i]:
            continue
        left[i] -= 1
        for j in range(max(0, i - vocabulary.longest), i):
            edge = vocabulary.edge(segment[j:i])
            if edge and best[j] > -np.inf:
                count += 1
                total = done + edge[0]
                heapq.heappush(heap, (-(total + best[j]), j, count, total, (edge[1], trail)))
    return out


def _ids(trail: tuple | None) -> tuple[int, ...]:
    """Ids along a trail of (ids, rest) pairs."""
    ids: list[int] = []
    while trail:
        ids.extend(trail[0])
        trail = trail[1]
    return tuple(ids)


def text_nbest(text: str, vocabulary: Vocabulary, n: int = NBEST) -> list[tuple[float, list[int]]]:
    """The ``n`` best segmentations of a whole text."""
    parts = segments(text)
    lists = [nbest(p, vocabulary, n) for p in parts]
    losses = sorted((x[0][0] - x[1][0], i) for i, x in enumerate(lists) if len(x) > 1)[: n - 1]
    total = sum(x[0][0] for x in lists)
    out = []
    for choice in _choices([[x[0][0] - s for s, _ in x] for x in (lists[i] for _, i in losses)], n):
        taken = dict(zip((i for _, i in losses), choice[1], strict=True))
        ids = [t for i, x in enumerate(lists) for t in x[taken.get(i, 0)][1]]
        out.append((total - choice[0], ids))
    return out


def _choices(losses: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` cheapest picks of one loss per list."""
    every = ((sum(x[k] for x, k in zip(losses, pick, strict=True)), pick) for pick in product(*[range(len(x)) for x in losses]))
    return heapq.nsmallest(n, every)


class _Memory:
    """Segments met by a worker: best ids, scores and losses, and N-best losses where they were asked for."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.names: list[str] = []
        self.ids: list[tuple[int, ...]] = []
        self.score: list[float] = []
        self.loss: list[float] = []
        self.more: dict[int, tuple[np.ndarray, list[tuple[int, ...]], bool]] = {}

    def learn(self, parts: set[str]) -> None:
        """Take in new segments in sorted order: each goes on from the prefix that it shares with the one before."""
        last, best, second, back = "", [0.0], [-np.inf], [None]
        for part in sorted(parts - self.known.keys()):
            if _literal(part):
                scores, other, ids = forward(part, self.vocabulary)
                self._add(part, scores[-1], other, ids)
                continue
            n, shared = min(len(last), len(part)), 0
            while shared < n and last[shared] == part[shared]:
                shared += 1
            del best[shared + 1 :], second[shared + 1 :], back[shared + 1 :]
            _extend(part, best, second, back, self.vocabulary)
            self._add(part, best[-1], second[-1], _best_ids(back))
            last = part

    def _add(self, part: str, best: float, second: float, ids: tuple[int, ...]) -> None:
        self.known[part] = len(self.ids)
        self.names.append(part)
        self.ids.append(ids)
        self.score.append(best)
        self.loss.append(best - second)

    def nbest(self, at: int, n: int) -> tuple[np.ndarray, list[tuple[int, ...]], bool]:
        """(losses, ids, whether they all stand for the same bytes) of the N best of a segment, the best one first."""
        found = self.more.get(at)
        if found is None:
            all_ = nbest(self.names[at], self.vocabulary, n)
            # Among equal scores the search may meet another one first, or n others.
            ids = [self.ids[at], *[x for _, x in all_ if x != self.ids[at]]][: len(all_)]
            text = self.vocabulary.text
            same = len({b"".join([text[i] for i in x]) for x in ids}) == 1
            found = self.more[at] = np.array([all_[0][0] - s for s, _ in all_]), ids, same
        return found


def _text_nbest(memory: _Memory, places: np.ndarray, losses: np.ndarray, n: int) -> tuple[np.ndarray, list[tuple]]:
    """What the ``n`` best segmentations of a text lose against the best, ascending, and the (segment, rank) pairs in which
    each differs from it."""
    m = min(n - 1, len(places))
    near = np.argpartition(losses, m - 1)[:m] if m and m < len(places) else range(len(places))
    total, picks = np.zeros(1), [()]
    for i in near:
        if losses[i] < np.inf:
            # The n smallest sums of two lists come from the n smallest of each.
            found = memory.nbest(int(places[i]), n)[0]
            sums = (total[:, None] + found).ravel()
            order = sums.argsort(kind="stable")[:n]
            total = sums[order]
            picks = [picks[k // len(found)] + (((int(i), k % len(found)),) if k % len(found) else ()) for k in order.tolist()]
    if picks[0]:
        picks = [(), *filter(None, picks)][: len(picks)]  # equal up to rounding
    return total, picks


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i] + sizes[i] - 1 of all spans in a row."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class _Others:
    """Segmentations of a slice of texts beside the best ones, as the runs of ids in which they differ from those."""

    def __init__(self) -> None:
        self.rows, self.edits, self.runs = [0], [0], [0]  # ends of the lists
        self.segments: list[int] = []
        self.ids: list[int] = []

    def add(self, memory: _Memory, places: np.ndarray, begin: int, picks: list[tuple], n: int) -> bool:
        """Take in those of the next text; whether all of them stand for its bytes."""
        sound = True
        for pick in picks:
            for i, rank in sorted(pick):
                _, ids, same = memory.nbest(int(places[begin + i]), n)
                sound = sound and same
                self.segments.append(begin + i)
                self.ids.extend(ids[rank])
                self.runs.append(len(self.ids))
            self.edits.append(len(self.segments))
        self.rows.append(len(self.edits) - 1)
        return sound

    def array(self, sizes: np.ndarray, row: np.ndarray, ids_at: np.ndarray) -> pa.Array:
        """Lists of edits by text, from the ids that every segment has in the best segmentation."""
        at = np.array(self.segments, np.int64)
        starts = (np.cumsum(sizes) - sizes)[at] - ids_at[row[at]]
        runs = pa.ListArray.from_arrays(pa.array(self.runs, pa.int32()), pa.array(self.ids, pa.int32()))
        edits = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(sizes[at], pa.int32()), runs], ["at", "drop", "ids"])
        return pa.ListArray.from_arrays(
            pa.array(self.rows, pa.int32()), pa.ListArray.from_arrays(pa.array(self.edits, pa.int32()), edits)
        )


def _encoded(model: tuple, n: int):
    memory: list[_Memory] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(*model)
        memory.append(_Memory(vocabulary))
        held = memory[-1]
        lengths = np.array([len(t) for t in vocabulary.text])
        starts = np.concatenate([[0], np.cumsum(lengths)])
        pool = np.frombuffer(b"".join(vocabulary.text), np.uint8)
        for batch in batches:
            column = batch.column(1)
            for first, end, data, at in slices(column, SLICE):
                if len(held.ids) > REMEMBERED:
                    held.clear()
                texts = column.slice(first, end - first).to_pylist()
                rows = end - first
                cut = [segments(text or "") for text in texts]
                held.learn(set().union(*cut))
                known = held.known
                places = np.array([known[p] for parts in cut for p in parts], np.int64)
                parts_at = np.concatenate([[0], np.cumsum([len(parts) for parts in cut])])
                row = np.repeat(np.arange(rows), np.diff(parts_at))
                totals = np.bincount(row, np.array(held.score)[places], minlength=rows)
                losses = np.array(held.loss)[places]
                scores, sound = [], []
                others = _Others()
                for k in range(rows):
                    begin, stop = parts_at[k], parts_at[k + 1]
                    lost, picks = _text_nbest(held, places[begin:stop], losses[begin:stop], n)
                    scores.append(totals[k] - lost)
                    sound.append(others.add(held, places, int(begin), picks[1:], n))
                # Ids of all segments side by side, then those of the slice.
                sizes = np.array([len(x) for x in held.ids], np.int64)
                stock = np.fromiter(chain.from_iterable(held.ids), np.int32, int(sizes.sum()))
                ids = stock[_spans((np.cumsum(sizes) - sizes)[places], sizes[places])]
                ids_at = np.concatenate([[0], np.cumsum(np.bincount(row, sizes[places], minlength=rows))]).astype(np.int64)
                # Decoded again from the pieces' bytes, to be compared with the text behind the first space.
                size = lengths[ids]
                back = pool[_spans(starts[ids], size)]
                back_at = np.concatenate([[0], np.cumsum(size)])[ids_at]
                same = [
                    sound[k]
                    and bool(np.array_equal(back[back_at[k] + (ids_at[k] < ids_at[k + 1]) : back_at[k + 1]], data[at[k] : at[k + 1]]))
                    for k in range(rows)
                ]
                lists = pa.ListArray.from_arrays(
                    pa.array(ids_at.astype(np.int32), mask=np.array([*[t is None for t in texts], False])), pa.array(ids)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, rows),
                        lists,
                        pa.array(np.diff(ids_at)),
                        pa.array(scores, pa.list_(pa.float64())),
                        pa.array(same, pa.bool_()),
                        others.array(sizes[places], row, ids_at),
                    ],
                    names=["key", "ids", "n_ids", "scores", "round_trip", "alternatives"],
                )

    return run


def _parts(vocabulary: Vocabulary) -> tuple:
    return vocabulary.scores, vocabulary.bytes_, vocabulary.byte_score, vocabulary.text, vocabulary.longest, vocabulary.ends


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL, n: int = NBEST) -> DataFrame:
    """(key, ids, n_ids, scores, round_trip, alternatives): one row per input row.

    ``ids`` is the best segmentation, ``scores`` are those of the up to ``n`` best in descending order. ``alternatives``
    holds the others of the ``n`` best in the same order, each as its differences from ``ids``: from place ``at`` on (0 is
    the first), ``drop`` ids are replaced by ``ids``; :func:`segmentations` writes them out. ``round_trip`` says whether
    decoding each of them gives the text back. A null text has null ids, an empty text none, both the score 0. Ties
    between segmentations go to the longer first piece from the right. Repeated rows give repeated results; an empty
    table gives no rows. Other columns are ignored, whatever their names; texts are encoded whole.
    """
    # A vocabulary file has a fixed number of pieces; it travels with the function.
    vocabulary = Vocabulary.load(model)
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = dict(source.dtypes)["key"]
    made = source.mapInArrow(
        _encoded(_parts(vocabulary), n),
        f"key {kind}, ids array<int>, n_ids bigint, scores array<double>, round_trip boolean, "
        "alternatives array<array<struct<at:int,drop:int,ids:array<int>>>>",
    )
    return made.withColumnRenamed("key", key)


def segmentations(ids: str = "ids", alternatives: str = "alternatives") -> Column:
    """The ids of the N best segmentations, the best one first."""

    def replaced(held: Column, edit: Column) -> Column:
        return F.concat(F.slice(held, 1, edit["at"]), edit["ids"], F.slice(held, edit["at"] + edit["drop"] + 1, F.size(held)))

    others = F.transform(alternatives, lambda edits: F.aggregate(F.reverse(edits), F.col(ids), replaced))
    return F.concat(F.array(ids), others)


def decode(rows: DataFrame, ids: str = "ids", text: str = "text", model: str = MODEL) -> DataFrame:
    """``rows`` with the text that the ids stand for, by expressions and one small Arrow function.

    Null ids give a null text, no ids an empty one. Other columns stay.
    """
    from pyspark.sql.functions import arrow_udf

    pieces = Vocabulary.load(model).text

    @arrow_udf("string")
    def joined(column: pa.Array) -> pa.Array:
        return pa.array(
            [None if x is None else b"".join(pieces[i] for i in x)[1:].decode("utf-8", "replace") for x in column.to_pylist()],
            pa.string(),
        )

    return rows.withColumn(text, joined(F.col(ids)))
