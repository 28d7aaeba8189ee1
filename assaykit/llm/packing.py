"""Hierarchical multi-length packing of tokenised documents.

A document's ids are cut into whole windows of the longest tier; what is left goes to the smallest tier that holds it. Each
tier packs its pieces into windows of its size, longest tier first; the gap of a window is filled from the shorter tiers, largest
fitting piece first, and the last gap by cutting a piece, so that every window is full. What a task has left at its end is packed into
windows of falling powers of two. Windows are dealt to step groups of equal tokens; a task's last group alone may hold fewer.

All work is inside a partition, in buffers of about ``BUFFER`` ids: no shuffle, and memory does not grow with the partition.
Edge cases: null and empty texts are the end id alone; a very long text is cut into many windows; repeated rows and null ids are
documents like others; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from assaykit.llm.common import text_groups

BUFFER = 1 << 20
#: Words and units of words that a worker keeps.
CACHE, UNITS = 250_000, 400_000
#: Bytes of text that are looked up at once.
LOOK_UP = 2 << 20
#: Letters of basic Latin and Latin-1, which normalisation only lower-cases; then signs, but no apostrophe.
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_SIGNS = ".,!?;:|$%&#*()+=/-"


class WordTokenizer:
    """Ids of texts by a tokenizer that drops white space and never joins across it: each word is looked up once.

    A word of letters and signs is two units, which the tokenizer's rules keep apart and its merges take one by one. All other words go
    through the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # bytes as the vocabulary writes them: printable ones stand for themselves, the others follow from 256 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        other = iter(range(256, 512))
        self.letters = {b: chr(b if b in plain else next(other)) for b in range(256)}
        for word in ("the", "café", "ÿþßà", "!?", "--"):
            if self._unit(word) != self.tokenizer.encode(word, add_special_tokens=False).ids:
                raise ValueError("the tokenizer doesn't take words apart as expected")
        self.clear()

    def _unit(self, text: str) -> list[int]:
        if not text.isascii():
            text = "".join(map(self.letters.__getitem__, text.lower().encode()))
        return [t.id for t in self.model.tokenize(text)]

    def clear(self) -> None:
        self.units: dict[str, int] = {}
        self.flat, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.clear_words()
        self._add_units([[]])
        self.units[""] = 0

    def clear_words(self) -> None:
        self.slot: dict[str, int] = {}
        self.pair = np.zeros((0, 2), np.int32)  # the two units of each word

    def _add_units(self, ids: list[list[int]]) -> None:
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.int32, int(length.sum()))])

    def _learn(self, words: list[str]) -> None:
        units, odd, split = self.units, [], []
        for word in words:
            base = word.rstrip(_SIGNS)
            if (base.isascii() and base.isalpha()) or _LETTERS.fullmatch(base):
                split.append((word, base.lower(), word[len(base) :]))
            elif word:
                odd.append(word)
            else:
                split.append(("", "", ""))
        new = list({u for _, a, b in split for u in (a, b) if u not in units})
        units.update(zip(new, range(len(self.length), len(self.length) + len(new)), strict=True))
        self._add_units([self._unit(u) for u in new])
        # words that are no units have their ids to themselves, as units without a name
        first = len(self.length)
        self._add_units([e.ids for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)])
        pairs = [(units[a], units[b]) for _, a, b in split] + [(first + i, 0) for i in range(len(odd))]
        self.slot.update(zip([w for w, _, _ in split] + odd, range(len(self.pair), len(self.pair) + len(pairs)), strict=True))
        self.pair = np.concatenate([self.pair, np.array(pairs, np.int32).reshape(-1, 2)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and how many each text has."""
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        edge = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
        edge -= edge[0]
        if not words:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        if len(self.length) > UNITS:
            self.clear()
        if len(self.slot) + len(words) > CACHE:
            self.clear_words()
        if new := [w for w in words if w not in self.slot]:
            self._learn(new)
        slots = np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))
        units = self.pair[slots[coded.indices.to_numpy()]].ravel()
        length = self.length[units]
        total = np.concatenate([[0], np.cumsum(length)])
        at = np.repeat(self.start[units] - total[:-1], length)
        at += np.arange(total[-1])
        return self.flat[at], np.diff(total[2 * edge])


@functools.cache
def tokenizer(path: str) -> WordTokenizer:
    """One per worker process, so that its words are known to later tasks."""
    return WordTokenizer(path)


class Packer:
    """Pieces (document, start, length) -> windows. tiers: rising powers of two."""

    def __init__(self, tiers: tuple[int, ...]) -> None:
        self.tiers = tiers
        self.pool: list[list[tuple[int, int, int]]] = [[] for _ in tiers]  # (length, document, start), sorted
        self.windows: list[tuple[int, list[tuple[int, int, int]]]] = []

    def route(self, doc: int, start: int, length: int) -> None:
        tier = bisect.bisect_left(self.tiers, length)
        bisect.insort(self.pool[tier], (length, doc, start))

    def add(self, doc: int, length: int) -> None:
        top = self.tiers[-1]
        whole = length // top
        for i in range(whole):
            self.windows.append((top, [(doc, i * top, top)]))
        if length % top:
            self.route(doc, whole * top, length % top)

    def held(self, tier: int) -> int:
        return sum(p[0] for p in self.pool[tier])

    def pack(self) -> None:
        for tier in range(len(self.tiers) - 1, -1, -1):
            held = [self.held(t) for t in range(tier + 1)]
            while self.pool[tier] and sum(held) >= self.tiers[tier]:
                self.windows.append((self.tiers[tier], self.fill(self.tiers[tier], tier, held)))

    def fill(self, size: int, tier: int, held: list[int]) -> list[tuple[int, int, int]]:
        """Pieces of this tier and those below that fill a window of ``size``; they hold ``held`` ids, enough for it."""
        out, gap = [], size
        while gap:
            for t in range(tier, -1, -1):
                pool = self.pool[t]
                k = bisect.bisect_right(pool, (gap, 1 << 62, 0)) - 1
                if k >= 0:
                    length, doc, start = pool.pop(k)
                    held[t] -= length
                    out.append((doc, start, length))
                    gap -= length
                    break
            else:  # nothing fits: a piece is cut
                t = next(t for t in range(tier + 1) if self.pool[t])
                length, doc, start = self.pool[t].pop(0)
                out.append((doc, start, gap))
                held[t] -= length
                rest = length - gap
                held[bisect.bisect_left(self.tiers, rest)] += rest
                self.route(doc, start + gap, rest)
                gap = 0
        return out

    def drain(self) -> list[tuple[int, int, int]]:
        """What has not been packed, as (document, start, length)."""
        left = [(doc, start, length) for pool in self.pool for length, doc, start in pool]
        self.pool = [[] for _ in self.tiers]
        return left

    def finish(self) -> None:
        """Packs the rest into windows of falling powers of two."""
        left = sorted(self.drain(), key=lambda p: -p[2])
        total = sum(p[2] for p in left)
        size = 1 << max(total.bit_length() - 1, 0)
        while left:
            while size > sum(p[2] for p in left):
                size //= 2
            out, gap = [], size
            while gap:
                doc, start, length = left.pop(0)
                used = min(gap, length)
                out.append((doc, start, used))
                gap -= used
                if used < length:
                    left.insert(0, (doc, start + used, length - used))
            self.windows.append((size, out))


_PIECES = [("start", T.LongType(), pa.int64()), ("length", T.LongType(), pa.int64()), ("doc_tokens", T.LongType(), pa.int64()), ("sequence_id", T.LongType(), pa.int64()), ("offset", T.LongType(), pa.int64()), ("sequence_length", T.LongType(), pa.int64()), ("step_group", T.LongType(), pa.int64()), ("ids", T.BinaryType(), pa.binary())]


def _pack(batches: Iterator[pa.RecordBatch], path: str, end_id: int, tiers: tuple[int, ...], step_tokens: int) -> Iterator[pa.RecordBatch]:
    words, packer = tokenizer(path), Packer(tiers)
    task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
    keys: list = []
    docs: list[np.ndarray] = []
    held, sequences, steps = 0, 0, 0

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal keys, docs, held, sequences, steps, packer
        packer.pack()
        if last:
            packer.finish()
        windows = sorted(packer.windows, key=lambda w: -w[0])  # falling powers of two fill step groups without a gap
        carried = []
        if not last:  # an open group goes on with the windows of the next flush
            edges = np.cumsum([w[0] for w in windows])
            n = int(np.searchsorted(edges, edges[-1] // step_tokens * step_tokens, side="right")) if windows else 0
            windows, carried = windows[:n], windows[n:]
        rows = []
        for size, out in windows:
            offset = 0
            for doc, start, length in out:
                rows.append((doc, start, length, task + sequences, offset, size, task + steps // step_tokens))
                offset += length
            sequences += 1
            steps += size
        if rows:
            doc, start, length, sequence, offset, size, step = map(list, zip(*rows, strict=True))
            ids = [docs[d][a : a + n].tobytes() for d, a, n in zip(doc, start, length, strict=True)]
            made = [pa.array([keys[d] for d in doc], kind), *(pa.array(c, pa.int64()) for c in (start, length, [len(docs[d]) for d in doc], sequence, offset, size, step)), pa.array(ids, pa.binary())]
            batch = pa.RecordBatch.from_arrays(made, names=["key", *(c for c, _, _ in _PIECES)])
            for i in range(0, len(rows), 500):
                yield batch.slice(i, 500)
        left = packer.drain()
        packer = Packer(tiers)
        used = sorted({d for d, _, _ in left} | {d for _, out in carried for d, _, _ in out})
        place = {d: i for i, d in enumerate(used)}
        keys, docs = [keys[d] for d in used], [docs[d] for d in used]
        held = sum(n for _, _, n in left) + sum(size for size, _ in carried)
        for d, a, n in left:
            packer.route(place[d], a, n)
        packer.windows = [(size, [(place[d], a, n) for d, a, n in out]) for size, out in carried]

    kind = pa.int64()
    for batch in batches:
        kind = batch.column("key").type
        for part, _, _ in text_groups(iter([batch]), limit=LOOK_UP):
            ids, length = words.encode(part.column("text"))
            edge = np.concatenate([[0], np.cumsum(length)])
            for key, a, b in zip(part.column("key").to_pylist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                keys.append(key)
                docs.append(np.append(ids[a:b], np.int32(end_id)))
                packer.add(len(docs) - 1, b - a + 1)
                held += b - a + 1
            if held > BUFFER:
                yield from flush(False)
    yield from flush(True)


def pack(docs: DataFrame, path: str, end_id: int = 2, tiers: tuple[int, ...] = (512, 1024, 2048, 4096), step_groups: int = 8, key: str = "doc_id") -> DataFrame:
    """One row per piece: the document's key, start, length, doc_tokens, sequence_id, offset, sequence_length, step_group and ids
    (little-endian unsigned 32-bit). path: the tokenizer's file, which every worker has."""
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers are rising powers of two")
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *(T.StructField(c, t) for c, t, _ in _PIECES)])
    made = docs.select(docs[key].alias("key"), "text").mapInArrow(functools.partial(_pack, path=path, end_id=end_id, tiers=tuple(tiers), step_tokens=step_groups * tiers[-1]), schema)
    return made.withColumnRenamed("key", key)
