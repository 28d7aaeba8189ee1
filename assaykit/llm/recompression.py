"""Substring dedup by recompression: words in long runs of words that occur elsewhere are found and removed.

Rounds replace neighbouring symbols by one: a run of two equal words, then pairs of a left and a right symbol, where a
symbol's side is a bit of its name. A name is a hash of what it replaces, so it is the same in every task and every Spark
round without a dictionary to pass on. What a symbol becomes depends on its direct neighbours only, so equal word
sequences get equal symbols except within a known margin of their ends (``Parse.margin``). A high-level symbol is a run of such
symbols of at least ``Parse.least`` words that starts at a boundary inside the margin; each window of ``width`` words has one, and the
least of them is its anchor. One Spark shuffle brings equal high-level symbols together, which reveals the repeats; those
with equal surroundings are verified by one wider name, the others by comparing every window around them.

Edge cases: null text has no words; texts under ``width`` words lose nothing; repeated rows are copies of each other, so a text
of at least ``width`` words that occurs twice is removed whole; a clashing extra column stays as it is.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import Rolling, Words, free_name, mix, pieces, spread, text_groups
from assaykit.llm.repeats import open_marks, per_row, per_text, row_spans, window_rows
from assaykit.llm.suffix_index import sample


class Parse:
    """The rounds for windows of ``width`` words and what they guarantee.

    A round joins at most two symbols, so it doubles the longest symbol; a window's outer symbols can differ between two
    copies by what one more symbol spans, so the margin grows by the longest symbol of the round before.
    """

    def __init__(self, width: int) -> None:
        self.width, self.rounds, self.margin, self.longest = width, [], 0, 1
        for kind in ("run", "pair"):
            margin, longest = self.margin + self.longest * (2 if kind == "run" else 1), 2 * self.longest
            if width - 2 * margin >= 5 * longest:
                self.rounds.append(kind)
                self.margin, self.longest = margin, longest
        inside = width - 2 * self.margin
        self.least = max(1, min(inside - 2 * self.longest + 2, inside * 3 // 8))
        #: Words from a window's first word to the last place where its anchor can start.
        self.back = width - self.margin - (self.least + self.longest - 1)

    def boundaries(self, names: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Places (word numbers) at which the last round's symbols start. text: the row that each word is in."""
        at = np.arange(len(names))
        for number, kind in enumerate(self.rounds):
            beside = text[at[1:]] == text[at[:-1]]
            if kind == "run":
                equal = (names[1:] == names[:-1]) & beside
                join = equal.copy()
                join[1:] &= ~equal[:-1]
                join[:-1] &= ~equal[1:]  # runs of exactly two; longer ones stay as they are
            else:
                right = (mix(names + np.uint64(number + 1)) >> np.uint64(40) & np.uint64(1)).astype(bool)
                join = ~right[:-1] & right[1:] & beside
            joined = np.flatnonzero(join)
            made = names.copy()
            made[joined] = mix(names[joined] * np.uint64(0x9E3779B97F4A7C15) + names[joined + 1] + np.uint64(number))
            stay = np.ones(len(names), bool)
            stay[joined + 1] = False
            names, at = made[stay], at[stay]
        return at


def word_anchors(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    parse = Parse(width)
    top = np.uint64(np.iinfo(np.uint64).max)
    for batch, data, offsets in text_groups(batches):
        words = Words(data, offsets)
        n = len(words.hash)
        if n < width:
            continue
        text = np.repeat(np.arange(batch.num_rows), words.count)
        at = parse.boundaries(words.hash, text)
        # a high-level symbol ends at the first boundary with at least ``least`` words, or at the text's end
        stop = np.append(at, n)[np.searchsorted(at, at + parse.least)]
        stop = np.minimum(stop, words.first[text[at] + 1])
        rolling = Rolling(words.hash)
        keys = np.full(n, top, np.uint64)
        keys[at] = rolling.of(at, stop)
        # the anchor of the window at q is the least symbol that starts from q + margin to q + back
        span = parse.back - parse.margin + 1
        pos = sample(keys, words.first[:-1] + parse.margin, words.first[1:] - width + 1 + parse.margin, span)
        row = text[pos]
        low, high = np.maximum(pos - parse.back, words.first[row]), np.minimum(pos - parse.margin + width, words.first[row + 1])
        context = mix(rolling.of(low, high) + (pos - low).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        key = [batch.column(k).to_numpy()[row] for k in ("h1", "h2")]
        yield from pieces(pa.RecordBatch.from_arrays([pa.array(np.zeros(len(pos), np.int64)), pa.array(np.zeros(len(pos), np.int64)), pa.array(keys[pos].view(np.int64)), pa.array(context.view(np.int64)), pa.array(key[0]), pa.array(key[1]), pa.array((pos - words.first[row]).astype(np.int32))], names=["order1", "order2", "name", "context", "h1", "h2", "pos"]))


def word_windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The hashes of the windows that can have an unsettled symbol as their anchor, in two rows.

    Windows that start early all hold the words just before the symbol, those that start late the words behind it: rows meet by these words
    too, so a common passage in many surroundings is no hot group.
    """
    parse = Parse(width)
    middle = (parse.back + parse.margin) // 2
    for batch, data, offsets in text_groups(batches):
        row, pos, name = open_marks(batch)
        if not len(row):
            continue
        words = Words(data, offsets)
        rolling, base, size = Rolling(words.hash), words.first[row], words.count[row]
        for side in (0, 1):
            first = np.maximum(pos - parse.back, 0) if side == 0 else np.maximum(pos - middle + 1, 0)
            last = np.minimum(pos - middle if side == 0 else pos - parse.margin, size - width)
            low, high = (pos - middle, pos - parse.back + width) if side == 0 else (pos - parse.margin, pos - middle + 1 + width)
            ok = np.flatnonzero(first <= last)
            at, first, last = base[ok], first[ok], last[ok]
            shared = rolling.of(at + low[ok], at + np.minimum(high[ok], size[ok]))
            key = mix(name[ok].view(np.uint64) + shared * np.uint64(0x9E3779B97F4A7C15) + np.uint64(side)).view(np.int64)
            owner, rank = spread(last - first + 1)
            start = (at + first)[owner] + rank
            raw = rolling.of(start, start + width).tobytes()
            ends = np.cumsum(last - first + 1) * 8
            begins = ends - (last - first + 1) * 8
            yield from window_rows(batch, row[ok], pos[ok], key, first - pos[ok], [raw[x:y] for x, y in zip(begins.tolist(), ends.tolist(), strict=True)])


def word_hashes(raw: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return lengths // 8, np.frombuffer(raw, np.uint64)


def word_finish(batches: Iterator[pa.RecordBatch], width: int, keep: Sequence[str] = ("h1", "h2"), marks: str = "marks", spans: str = "spans") -> Iterator[pa.RecordBatch]:
    """Removes the covered words with the white space after each. The columns ``keep`` pass."""
    parse = Parse(width)
    for batch, data, offsets in text_groups(batches):
        words = Words(data, offsets)
        row, start, end = row_spans(batch, words.count, width, parse.back, parse.margin, marks, spans)
        gone = np.zeros(len(data) + 1, np.int32)
        edge = np.append(words.start, len(data))
        first, last = words.first[row] + start, words.first[row] + end
        np.add.at(gone, edge[first], 1)
        np.add.at(gone, np.minimum(edge[last], offsets[row + 1]), -1)
        kept = np.cumsum(gone[:-1]) == 0
        left = np.concatenate([[0], np.cumsum(kept)])[offsets]
        ends = np.searchsorted(row, np.arange(len(words.count) + 1))
        pairs = pa.StructArray.from_arrays([pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64))], ["start", "end"])
        body = pa.Array.from_buffers(pa.string(), len(words.count), [None, pa.py_buffer(left.astype(np.int32)), pa.py_buffer(data[kept].tobytes())])
        yield from pieces(pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(words.count), body, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pairs)], names=[*keep, *(free_name(list(keep), c) for c in ("n_words", "kept", "spans"))]), 1000)


def _family(width: int) -> tuple:
    """What ``per_text`` and ``per_row`` take after docs."""
    steps = (functools.partial(f, width=width) for f in (word_anchors, word_windows))
    return *steps, word_hashes, functools.partial(word_finish, width=width), "n_words long, kept string, spans array<struct<start: long, end: long>>"


def repeated_words(docs: DataFrame, width: int = 35) -> DataFrame:
    """Per distinct text: h1, h2, n_words, kept (the text without the removed words), spans (removed runs of word numbers)."""
    return per_text(docs, *_family(width))


def remove_repeated_words(docs: DataFrame, width: int = 35) -> DataFrame:
    """The rows of ``docs`` with added columns n_words, kept and spans. A text that loses nothing stays as it is."""
    return per_row(docs, *_family(width))
