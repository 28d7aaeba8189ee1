"""SentencePiece encoding and decoding, with a max-plus parallel scan for giant texts.

``encode`` gives the ids that the model's own encoder gives, for models of both kinds (of giant texts and unigram models, up to equally good segmentations):

* unigram: the segmentation with the largest sum of scores;
* BPE: the segmentation that greedy merging leaves. It is the only one whose pieces come out whole when merged alone and
  whose neighbours come out as they are when merged together, so it is a best path too: a step between pieces that would merge weighs
  minus infinity, every other step nothing.

A space opens a new word and no piece runs from a word into the next space, so words are apart from each other. Texts under ``chunk``
characters are cut into words, and the library encodes each distinct word of a batch once. Giant texts are cut into chunks at
fixed places, words or not. A *state* at a cut is the piece that the path has there (where it starts and ends); each chunk becomes the
transfer matrix of the best weight from every state at its begin to every state at its end. Matrices are combined associatively, ``FAN`` neighbours at
a time in rounds of Spark groups, until one is left of each text; going down again, every product gives its factors their states,
and each chunk is traced back by itself from its two states.

Unigram weights are whole numbers: scores times 2**16, then 20 bits drawn from a piece and its place in the word that set ties, so the result
doesn't depend on the cuts. ``decode`` turns ids back into text.

Edge cases: null and empty texts have no pieces and decode to the empty text; any text decodes to itself, also one that holds the model's
space sign, which is encoded by its bytes (here alone ids differ from the library's, which takes it for a space); very long texts, with or without spaces, are chunked;
repeated rows give equal results; an id that is no piece decodes to nothing; the added columns get an underscore where the input has their names.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm.common import free_name, list_column, mix, text_key

CHUNK, FAN = 1 << 15, 32
#: Bytes of texts that are encoded at once.
GROUP = 8 << 20
NEVER = -(1 << 62)
UNIGRAM, BPE = 1, 2
SIGN = "▁"
_UNIT = re.compile(r" *[^ ]+| +")
#: Where a word begins, seen from the character before.
_START = re.compile(r"[^ ](?= )")

#: A piece on a path: its start and end relative to a cut, and its id (-1: a character that has none and is written by its bytes).
State = tuple[int, int, int]
#: Before the first piece of a word nothing can clash.
FRESH: State = (0, 0, -2)


class Pieces:
    """A model's pieces with spaces for the space sign."""

    def __init__(self, path: str | None = None, proto: bytes | None = None) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path, model_proto=proto)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        rules, self.kind = model.normalizer_spec, model.trainer_spec.model_type
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the model changes texts before it cuts them")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model of kind {self.kind}")
        size = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(size)]
        plain = [i for i, p in enumerate(model.pieces) if p.type == p.NORMAL]
        if any(p.type in (p.USER_DEFINED, p.UNUSED) for p in model.pieces):
            raise ValueError("user-defined or unused pieces")
        self.score = np.array([self.library.get_score(i) for i in range(size)], np.float64)
        self.piece = {names[i].replace(SIGN, " "): i for i in plain}
        self.name = {i: p for p, i in self.piece.items()}
        self.longest = max(map(len, self.piece), default=1)
        #: Every prefix of a piece; the value is the id of a piece and -1 for a mere prefix.
        self.prefix = {name[:n]: -1 for name in self.piece for n in range(1, len(name))} | self.piece
        self.byte = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        of_byte = {i: b for b, i in enumerate(self.byte)}
        if len(of_byte) != 256 or any(" " in p.lstrip(" ") for p in self.piece):
            raise ValueError("characters without a piece, or words, can't be told apart")
        lowest = min((self.score[i] for i in plain), default=0.0)
        #: What the library's search adds to a character without a piece.
        self.fallback = int(round((lowest - 10) * (1 << 16))) << 20
        self.odd = (mix(np.arange(size)) >> np.uint64(32) | np.uint64(1)).tolist()
        self.weight = [int(round(s * (1 << 16))) << 20 for s in self.score.tolist()] if self.kind == UNIGRAM else []
        self.clash: dict[tuple[str, str], bool] = {}
        # what each id stands for, laid end to end, for decoding
        body = [bytes([of_byte[i]]) if i in of_byte else self.name.get(i, "").encode() for i in range(size)]
        self.body, self.size = np.frombuffer(b"".join(body), np.uint8), np.array([len(b) for b in body], np.int64)

    def merged(self, text: str) -> list[str]:
        """Greedy merging: the pair whose joint piece has the highest score, the leftmost first, until no pair has a piece."""
        parts: list[str | None] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if 0 <= i and after[i] < len(parts) and (k := self.piece.get(both := parts[i] + parts[after[i]])) is not None:
                heapq.heappush(heap, (-self.score[k], i, both))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if parts[i] is None or after[i] >= len(parts) or parts[i] + parts[after[i]] != both:
                continue
            parts[i], parts[after[i]], after[i] = both, None, after[after[i]]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return [p for p in parts if p is not None]

    def may_follow(self, left: str, right: str) -> bool:
        """BPE: do these two pieces, or characters without one, stay as they are when merged together?"""
        known = self.clash.get((left, right))
        if known is None:
            if len(self.clash) > 1_000_000:
                self.clash.clear()
            known = self.clash[left, right] = self.merged(left + right) == [left, right]
        return known

    def steps(self, text: str, at: int, place: int) -> list[tuple[int, int, int]]:
        """(length, id, weight) of the pieces that a path can take at text[at], ``place`` characters into its word."""
        out, single, stop = [], False, at + 1
        while stop <= len(text):
            hit = self.prefix.get(text[at:stop])
            if hit is None:
                break
            if hit >= 0:
                single = single or stop == at + 1
                out.append((stop - at, hit, self.weight[hit] + (self.odd[hit] * (2 * place + 1) >> 12 & 0xFFFFF) if self.weight else 0))
            stop += 1
        if not single:
            out.append((1, -1, self.fallback if self.weight else 0))
        return out

    def places(self, text: str, lead: int) -> list[int]:
        """How far each character is into its word, the first one ``lead`` characters, where weights depend on it."""
        if self.kind == BPE:
            return [0] * len(text)
        out = [lead]
        for before, c in zip(text, text[1:], strict=False):
            out.append(0 if c == " " != before else out[-1] + 1)
        return out

    def fits(self, text: str, last: State, at: int, n: int) -> bool:
        """May the piece text[at:at + n] come after the path's last piece?"""
        if self.kind == UNIGRAM or last == FRESH:
            return self.kind == UNIGRAM or self.merged(text[at : at + n]) == [text[at : at + n]]
        return self.may_follow(text[last[0] : last[1]], text[at : at + n])

    def key(self, at: int, n: int, i: int) -> State:
        """What a path's future depends on: for unigram where its last piece ends, for BPE the piece."""
        return (at + n, at + n, 0) if self.kind == UNIGRAM else (at, at + n, i)

    def states(self, text: str, cut: int, sync: bool) -> list[State]:
        """All states that a path can have at a cut, the same from both sides. ``sync``: a word or the text begins or ends here."""
        if sync:
            return [FRESH]
        out = set()
        for at in range(max(0, cut - self.longest), cut):
            for n, i, _ in self.steps(text, at, 0):
                if at + n >= cut:
                    a, b, i = self.key(at, n, i)
                    out.add((a - cut, b - cut, i))
        return sorted(out)

    def sweep(self, text: str, begin: int, end: int, place: list[int], entries: list[State], trace: bool = False) -> tuple[list[dict[State, np.ndarray]], dict]:
        """reach[k][state]: best weight from each entry (states at ``begin``) to a path whose last piece starts before ``end`` and ends at k.

        Places are offsets in ``text``. With ``trace``, also what piece led to each state.
        """
        reach: list[dict[State, np.ndarray]] = [{} for _ in range(len(text) + 1)]
        back: dict[State, tuple] = {}
        for e, (a, b, i) in enumerate(entries):
            state = FRESH if (a, b, i) == FRESH else (a + begin, b + begin, i)
            k = begin + b
            if k < len(reach):
                got = reach[k].setdefault(state, np.full(len(entries), NEVER, np.int64))
                got[e] = 0
        for at in range(begin, end):
            here = reach[at]
            if not here:
                continue
            for n, i, w in self.steps(text, at, place[at]):
                new, best, came = self.key(at, n, i), None, None
                for state, value in here.items():
                    if self.fits(text, state, at, n):
                        if not trace:
                            best = value if best is None else np.maximum(best, value)
                        elif best is None or value[0] > best[0]:
                            best, came = value, state
                if best is None:
                    continue
                best, old = np.where(best > NEVER, best + w, NEVER), reach[at + n].get(new)
                if trace and (old is None or best[0] > old[0]):
                    back[new] = (came, at, n, i)
                reach[at + n][new] = best if old is None else np.maximum(old, best)
            if not trace and at > begin:
                reach[at - 1] = {}
        return reach, back

    def leaves(self, reach: list[dict[State, np.ndarray]], end: int, exits: list[State], entries: int) -> np.ndarray:
        out = np.full((entries, len(exits)), NEVER, np.int64)
        for x, (a, b, i) in enumerate(exits):
            found = reach[end].values() if (a, b, i) == FRESH else [reach[end + b].get((a + end, b + end, i))] if end + b < len(reach) else []
            for value in found:
                if value is not None:
                    out[:, x] = np.maximum(out[:, x], value)
        return out

    def transfer(self, text: str, begin: int, end: int, lead: int, first: bool, last: bool) -> np.ndarray:
        """The matrix of the chunk text[begin:end]; ``text`` has ``longest`` characters more on both sides where there are any.

        All paths meet where a word begins, so only what is before the first and behind the last of these places depends on the states.
        """
        place = self.places(text, lead)
        entries, exits = self.states(text, begin, first or self.opens(text, begin)), self.states(text, end, last or self.opens(text, end))
        starts = [m.start() + 1 for m in _START.finditer(text, begin, end) if begin < m.start() + 1 < end]
        if entries == [FRESH]:
            starts = [begin, *starts]
        # a state's piece never runs past the next word's begin
        if not starts:
            reach, _ = self.sweep(text[: end + self.longest], begin, end, place, entries)
            return self.leaves(reach, end, exits, len(entries))
        if entries == [FRESH]:
            enter = np.zeros(1, np.int64)
        else:
            reach, _ = self.sweep(text[: starts[0]], begin, starts[0], place, entries)
            enter = self.leaves(reach, starts[0], [FRESH], len(entries))[:, 0]
        # what is between the first and the last word's begin weighs the same for all states, so it is left out
        if exits == [FRESH]:
            leave = np.zeros(1, np.int64)
        else:
            reach, _ = self.sweep(text[: end + self.longest], starts[-1], end, place, [FRESH])
            leave = self.leaves(reach, end, exits, 1)[0]
        held = (enter > NEVER)[:, None] & (leave > NEVER)
        return np.where(held, np.where(enter > NEVER, enter, 0)[:, None] + np.where(leave > NEVER, leave, 0), NEVER)

    @staticmethod
    def opens(text: str, at: int) -> bool:
        """Does a word begin at text[at]?"""
        return 0 < at < len(text) and text[at] == " " != text[at - 1]

    def route(self, text: str, begin: int, end: int, place: list[int], entry: State, leave: State) -> list[int]:
        """Ids of the best path from one state at ``begin`` to one at ``end``."""
        if entry != FRESH and begin + entry[1] > end:
            return []  # the piece before reaches over all of this
        reach, back = self.sweep(text if leave != FRESH else text[:end], begin, end, place, [entry], trace=True)
        goal = max(reach[end].items(), key=lambda x: x[1][0])[0] if leave == FRESH else (leave[0] + end, leave[1] + end, leave[2])
        start = FRESH if entry == FRESH else (entry[0] + begin, entry[1] + begin, entry[2])
        out = []
        while goal != start:
            goal, at, n, i = back[goal]
            out.append([i] if i >= 0 else [self.byte[b] for b in text[at : at + n].encode()])
        return [i for part in reversed(out) for i in part]

    def chunk_path(self, text: str, begin: int, end: int, lead: int, first: bool, last: bool, entry: int, leave: int) -> np.ndarray:
        """Ids of the pieces that start in a chunk, on the best path from its entry state to its exit state."""
        place = self.places(text, lead)
        came, went = self.states(text, begin, first or self.opens(text, begin))[entry], self.states(text, end, last or self.opens(text, end))[leave]
        starts = [m.start() + 1 for m in _START.finditer(text, begin, end) if begin < m.start() + 1 < end]
        if came == FRESH:
            starts = [begin, *starts]
        if not starts:
            return np.array(self.route(text[: end + self.longest], begin, end, place, came, went), np.int32)
        head = self.route(text[: starts[0]], begin, starts[0], place, came, FRESH) if starts[0] > begin else []
        if went == FRESH:
            return np.array(head + self.words([text[a:b] for a, b in zip(starts, [*starts[1:], end], strict=True)]), np.int32)
        body = self.words([text[a:b] for a, b in zip(starts, starts[1:], strict=False)])
        return np.array(head + body + self.route(text[: end + self.longest], starts[-1], end, place, FRESH, went), np.int32)

    def words(self, words: list[str]) -> list[int]:
        """Ids of words laid end to end, each with its leading spaces. In a scan of a unigram model ties are set as the scan does."""
        distinct = list(set(words))
        known = dict(zip(distinct, self.encode_words(distinct) if self.kind == BPE else map(self.one_word, distinct), strict=True))
        return [i for w in words for i in known[w]]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The library's ids of each word; the space that it puts before a text is a word's first one."""
        out = self.library.encode([w[1:] for w in words], num_threads=1)
        for k, w in enumerate(words):
            if w == " " or SIGN in w:  # the empty text has no space put before it; the sign itself is no space
                out[k] = self.one_word(w)
        return out

    def one_word(self, word: str) -> list[int]:
        return self.route(word, 0, len(word), self.places(word, 0), FRESH, FRESH)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has. Texts get a space before them, as the model asks."""
        texts = texts.fill_null("")
        lists = pc.split_pattern(texts, " ")
        counts = np.diff(np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]).astype(np.int64)
        flat = lists.flatten()
        if not len(flat):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        coded = flat.dictionary_encode()
        # texts with spaces in a row, at an end, or without words are cut by a pattern instead
        blank = np.add.reduceat(pc.equal(flat, "").to_numpy(zero_copy_only=False), np.cumsum(counts) - counts) > 0
        other = {i: _UNIT.findall(" " + texts[i].as_py()) if texts[i].as_py() else [] for i in np.flatnonzero(blank).tolist()}
        words = [" " + w for w in coded.dictionary.to_pylist()]
        extra = list({w for units in other.values() for w in units})
        made = self.encode_words(words + extra)
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        ids = np.fromiter((i for x in made for i in x), np.int32, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        index = coded.indices.to_numpy()
        if other:
            of_extra = {w: len(words) + k for k, w in enumerate(extra)}
            ends = np.cumsum(counts)
            parts = [np.array([of_extra[w] for w in other[i]], np.int64) if i in other else index[ends[i] - counts[i] : ends[i]] for i in range(len(counts))]
            counts, index = np.array([len(p) for p in parts], np.int64), np.concatenate(parts).astype(np.int64)
        length = sizes[index]
        total = np.concatenate([[0], np.cumsum(length)])
        at = np.repeat(starts[index] - total[:-1], length) + np.arange(total[-1])
        n = np.diff(total[np.concatenate([[0], np.cumsum(counts)])])
        return ids[at], n

    def decode_all(self, ids: np.ndarray, count: np.ndarray) -> list[str]:
        """Texts of lists of ids laid end to end."""
        ids = np.where((ids >= 0) & (ids < len(self.size)), ids, 0)
        size = self.size[ids]
        start = np.cumsum(self.size) - self.size
        total = np.concatenate([[0], np.cumsum(size)])
        data = self.body[np.repeat(start[ids] - total[:-1], size) + np.arange(total[-1])].tobytes()
        edge = total[np.concatenate([[0], np.cumsum(count)])].tolist()
        texts = (data[a:b].decode("utf-8", "replace") for a, b in zip(edge, edge[1:], strict=False))
        return [t[1:] if t.startswith(" ") else t for t in texts]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([len(ids)]))[0]


@functools.cache
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product of two transfer matrices; associative but for a constant, which no choice of states depends on."""
    out = np.full((len(a), b.shape[1]), NEVER, np.int64)
    for k in range(len(b)):
        x, y = a[:, k, None], b[None, k]
        held = (x > NEVER) & (y > NEVER)
        np.maximum(out, np.where(held, np.where(held, x, 0) + np.where(held, y, 0), NEVER), out=out)
    top = out.max(initial=NEVER)
    return np.where(out > NEVER, out - top, NEVER)  # so that weights of giant texts stay in 64 bits


def best_states(matrices: list[np.ndarray], entry: int, leave: int) -> list[int]:
    """The states between neighbours on the best way through a row of matrices, from one state to another."""
    front, fronts = matrices[0][entry : entry + 1], []
    for m in matrices[1:]:
        fronts.append(front[0])
        front = compose(front, m)
    out = []
    for f, m in zip(reversed(fronts), reversed(matrices[1:]), strict=True):
        way = m[:, leave]
        leave = int(np.where((f > NEVER) & (way > NEVER), f + np.where(way > NEVER, way, 0), NEVER).argmax())
        out.append(leave)
    return out[::-1]


def lead_of(text: str, at: int) -> int:
    """How far text[at] is into its word."""
    start = max(text.rfind(" ", 0, at + 1), 0)
    while start and text[start - 1] == " ":
        start -= 1
    return at - start


_CHUNK = "h1 long, h2 int, k int, begin int, end int, lead int, first boolean, last boolean, body string"
_SHAPE = ("begin", "end", "lead", "first", "last")


def _cut(batches: Iterator[pa.RecordBatch], longest: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """Texts -> chunks, each with ``longest`` characters of its neighbours."""
    for batch in batches:
        for h1, h2, text in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "text")), strict=True):
            text = " " + text
            for k, a in enumerate(range(0, len(text), chunk)):
                low, b = max(0, a - longest), min(a + chunk, len(text))
                row = (h1, h2, k, a - low, b - low, lead_of(text, low), a == 0, b == len(text), text[low : b + longest])
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=[c.split()[0] for c in _CHUNK.split(", ")])


def _pack(m: np.ndarray) -> bytes:
    return np.array(m.shape, np.int64).tobytes() + m.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    n = np.frombuffer(raw, np.int64)
    return n[2:].reshape(n[:2])


def _transfer(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = pieces_of(path)
    for batch in batches:
        made = [_pack(model.transfer(*x)) for x in zip(*(batch.column(c).to_pylist() for c in ("body", *_SHAPE)), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h1", "h2", "k")), pa.array(made, pa.binary())], names=["h1", "h2", "k", "matrix"])


def _product(rows: pd.DataFrame, fan: int) -> pd.DataFrame:
    """Up to ``fan`` neighbours of one text -> their product."""
    rows = rows.sort_values("k")
    product = functools.reduce(compose, map(_unpack, rows["matrix"]))
    return pd.DataFrame({"h1": rows["h1"].iloc[:1], "h2": rows["h2"].iloc[:1], "k": rows["k"].iloc[:1] // fan, "matrix": [_pack(product)]})


def _states(rows: pd.DataFrame) -> pd.DataFrame:
    """Neighbours of one text with their product's states -> the states of each."""
    rows = rows.sort_values("k")
    entry, leave = int(rows["entry"].iloc[0]), int(rows["leave"].iloc[0])
    between = best_states([_unpack(m) for m in rows["matrix"]], entry, leave)
    return pd.DataFrame({"h1": rows["h1"], "h2": rows["h2"], "k": rows["k"], "entry": [entry, *between], "leave": [*between, leave]})


def _trace(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = pieces_of(path)
    for batch in batches:
        made = [model.chunk_path(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("body", *_SHAPE, "entry", "leave")), strict=True)]
        score = [float(model.score[m].sum()) for m in made]
        parts = list_column(np.concatenate(made), np.array([len(m) for m in made]), pa.int32()) if made else pa.array([], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h1", "h2", "k")), parts, pa.array(score, pa.float64())], names=["h1", "h2", "k", "part", "weight"])


def scan_states(matrices: DataFrame, most: int, fan: int) -> DataFrame:
    """h1, h2, k, entry, leave of each chunk of each text: products up a tree of rounds, states down again. most: chunks of the longest text."""
    levels = [matrices]
    while most > fan:
        levels.append(levels[-1].withColumn("up", F.floor(F.col("k") / fan)).groupBy("h1", "h2", "up").applyInPandas(lambda rows: _product(rows, fan), "h1 long, h2 int, k int, matrix binary"))
        most = -(-most // fan)
    # the top is one group a text, which begins and ends without a piece
    states = levels[-1].groupBy("h1", "h2").agg(F.lit(0).alias("up"), F.lit(0).alias("entry"), F.lit(0).alias("leave"))
    for level in reversed(levels):
        parts = level.withColumn("up", F.floor(F.col("k") / fan).cast("int")).join(states, ["h1", "h2", "up"])
        states = parts.groupBy("h1", "h2", "up").applyInPandas(_states, "h1 long, h2 int, k int, entry int, leave int").withColumnRenamed("k", "up")
    return states.withColumnRenamed("up", "k")


def _by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches cut where the bytes of ``column`` reach the limit."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + limit, "right")))
            yield batch.slice(start, end - start)
            start = end


def _encode(batches: Iterator[pa.RecordBatch], path: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    model = pieces_of(path)
    for part in _by_bytes(batches, "text", GROUP):
        ids, n = model.encode(part.column("text"))
        score = np.diff(np.concatenate([[0.0], np.cumsum(model.score[ids])])[np.concatenate([[0], np.cumsum(n)])]).round(6)
        yield pa.RecordBatch.from_arrays([*part.columns, list_column(ids, n, pa.int32()), pa.array(score, pa.float64())], names=names)


def encode(docs: DataFrame, path: str, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """``docs`` with ids (array of int) and score (the sum of the pieces' scores). path: the model file, which every worker has."""
    ids, score, h1, h2 = (free_name(docs.columns, c) for c in ("ids", "score", "h1", "h2"))
    longest = pieces_of(path).longest
    giant = F.coalesce(F.length("text") >= chunk, F.lit(False))
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(score, T.DoubleType())])
    usual = docs.where(~giant).mapInArrow(functools.partial(_encode, path=path, names=schema.fieldNames()), schema)
    most = docs.agg(F.max(F.length("text"))).first()[0] or 0
    if most < chunk:
        return usual
    keyed = docs.where(giant).withColumns(dict(zip((h1, h2), text_key(F.col("text")), strict=True)))
    texts = keyed.groupBy(F.col(h1).alias("h1"), F.col(h2).alias("h2")).agg(F.first("text").alias("text"))
    chunks = texts.mapInArrow(functools.partial(_cut, longest=longest, chunk=chunk), _CHUNK).repartition("h1", "h2", "k")
    matrices = chunks.mapInArrow(functools.partial(_transfer, path=path), "h1 long, h2 int, k int, matrix binary")
    states = scan_states(matrices, -(-(most + 1) // chunk), fan)
    parts = chunks.join(states, ["h1", "h2", "k"]).mapInArrow(functools.partial(_trace, path=path), "h1 long, h2 int, k int, part array<int>, weight double")
    whole = parts.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("k", "part", "weight"))).alias("parts"))
    total = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["weight"])
    whole = whole.select(F.col("h1").alias(h1), F.col("h2").alias(h2), F.flatten("parts.part").alias(ids), F.round(total, 6).alias(score))
    return usual.unionByName(keyed.join(whole, [h1, h2], "left").drop(h1, h2))


def _decode(batches: Iterator[pa.RecordBatch], path: str, ids: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    model = pieces_of(path)
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            lists = part.column(ids)
            count = np.diff(np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]).astype(np.int64)
            made = pa.array(model.decode_all(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), count), pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, pc.if_else(lists.is_valid(), made, pa.scalar(None, pa.string()))], names=names)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """df with decoded, the text of ``ids``."""
    name = free_name(df.columns, "decoded")
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])
    return df.mapInArrow(functools.partial(_decode, path=path, ids=ids, names=schema.fieldNames()), schema)
