"""Cross-tokenizer alignment: where the tokens of two tokenizers end together, and which of their tokens meet most.

A is a byte-level BPE over a space and the text, B a SentencePiece model over the text (it adds the space itself). Both give token ends as byte offsets.

Method: lockstep merging. A NumPy state vector holds, for each lane, a pointer into A's ends and one into B's ends. A step compares the two ends of all
lanes at once: the pointer at the smaller end advances, and where both are equal a link and a cut are emitted and both advance. Lanes that are done are
compacted away. A lane is a document, or one of the stretches of ``LANE`` bytes that a longer document is dealt in: a link belongs to the lane
that its end lies in, so stretches need nothing of each other and a giant text costs no more steps than a short one.

Counts of linked id pairs are corpus-wide: a block of documents (what a task holds at a time) sends each distinct pair once, counts are summed and
go back to the blocks that have the pair. So what is shuffled grows with blocks and their vocabulary, not with tokens.

Ids are the libraries' own: each distinct word of a batch is encoded once. A space between two characters that are no white space always begins a
token of A, so texts are cut there; texts with other white space beside a space are encoded whole. Texts that hold the model's space sign are never equal to what B decodes to.

Edge cases: null and empty texts, and texts whose joined token bytes differ from the space and the text, have no tokens and zeros, and their pairs count nowhere; repeated rows count as
often as they occur; an empty table gives no row; very long texts are lanes of their own, words without a space are encoded whole; columns of the input are told apart by name from the operator's own, which get an underscore where
they clash.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm.common import free_name, kept, list_column, spread
from assaykit.llm.pieces_scan import SIGN, pieces_of

#: Bytes of a lane, and of the texts that are encoded at once.
LANE, GROUP = 1 << 9, 4 << 20
#: Bytes of texts whose pairs are counted together.
BLOCK = 32 << 20
#: White space beside a space, or at an end.
_UNSAFE = re.compile(r"\s\s|^\s|\s$")


class ByteTokens:
    """A byte-level BPE vocabulary file: ids and bytes of tokens."""

    def __init__(self, path: str) -> None:
        import tiktoken
        import tokenizers
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"]
        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        special = {t["id"] for t in spec["added_tokens"]}
        # the printable characters that stand for bytes: those of Latin-1 that are visible for themselves, then from U+0100 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.body = [b""] * (max(model["vocab"].values(), default=-1) + 1)
        for token, i in model["vocab"].items():
            if i not in special:
                self.body[i] = bytes(byte[c] for c in token)
        ranks = {b: i for i, b in enumerate(self.body) if b}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [ranks.get(bytes(byte[c] for c in a + b), -1) for a, b in merges]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec.get("normalizer") and not model.get("ignore_merges")
        # ids that are in the order of the merges can serve as ranks; else the file's own library does all
        self.quick = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if plain and order == sorted(order) and -1 not in order and len(set(order)) == len(order) else None
        self.known: dict[str, list[int]] = {}

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        if self.quick is not None:
            return [self.quick.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Words that texts share are remembered, up to a million of at most 64 characters."""
        known = self.known
        if len(known) > 1_000_000:
            known.clear()
        fresh = [w for w in words if w not in known]
        made = dict(zip(fresh, self.encode_all(fresh), strict=True))
        known.update((w, x) for w, x in made.items() if len(w) <= 64)
        return [made[w] if w in made else known[w] for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a space and each text, laid end to end, and how many each has."""
        whole = texts.to_pylist()
        odd = np.array([self.quick is None or _UNSAFE.search(" " + t) is not None for t in whole], bool)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for rows, units in ((np.flatnonzero(~odd), True), (np.flatnonzero(odd), False)):
            some = texts.take(pa.array(rows)) if len(rows) else texts.slice(0, 0)
            lists = pc.split_pattern(some, " ") if units else None
            if not len(rows):
                parts.append((np.zeros(0, np.int32), np.zeros(0, np.int64)))
                continue
            flat = lists.flatten() if units else some
            count = np.diff(np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]) if units else np.ones(len(rows), np.int64)
            coded = flat.dictionary_encode()
            words = [" " + w for w in coded.dictionary.to_pylist()]
            made = self.encode_words(words) if units else self.encode_all(words)
            size = np.fromiter(map(len, made), np.int64, len(made))
            ids = np.fromiter((i for x in made for i in x), np.int32, int(size.sum()))
            first, index = np.cumsum(size) - size, coded.indices.to_numpy()
            owner, rank = spread(size[index])
            total = np.concatenate([[0], np.cumsum(size[index])])
            edge = total[np.concatenate([[0], np.cumsum(count)])]
            parts.append((ids[first[index][owner] + rank], np.diff(edge)))
        if not odd.any():
            return parts[0]
        n = np.zeros(len(whole), np.int64)
        n[~odd], n[odd] = parts[0][1], parts[1][1]
        out, of = np.empty(int(n.sum()), np.int32), np.repeat(odd, n)
        out[~of], out[of] = parts[0][0], parts[1][0]
        return out, n


@functools.cache
def byte_tokens(path: str) -> ByteTokens:
    return ByteTokens(path)


def lockstep(a_end: np.ndarray, b_end: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) of each end that both have, by place. The ends rise; lane k has the ends in (starts[k], stops[k]]."""
    a, b = np.searchsorted(a_end, starts, "right"), np.searchsorted(b_end, starts, "right")
    far = np.iinfo(np.int64).max
    a_end, b_end = np.append(a_end, far), np.append(b_end, far)
    stop, links = stops, []
    while len(a):
        x, y = a_end[a], b_end[b]
        # a lane is done when one side has no more ends in it: no link can follow
        live = np.maximum(x, y) <= stop
        if not live.all():
            a, b, x, y, stop = a[live], b[live], x[live], y[live], stop[live]
        hit = np.flatnonzero(x == y)
        links.append((a[hit], b[hit]))
        a, b = a + (x <= y), b + (y <= x)
    at = [np.concatenate(side) for side in zip(*links, strict=True)] if links else [np.zeros(0, np.int64)] * 2
    order = np.argsort(at[0], kind="stable")
    return at[0][order], at[1][order]


def lanes(edges: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of stretches of at most ``lane`` bytes of documents that lie end to end between ``edges``."""
    size = np.diff(edges)
    count = -(-size // lane)
    owner, rank = spread(count)
    start = edges[:-1][owner] + rank * lane
    return start, np.minimum(start + lane, edges[1:][owner])


def written(ids: np.ndarray, kind: np.ndarray, digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ids in decimal, each with the sign of its kind behind it, and their lengths."""
    text = digits[ids]
    text[np.arange(len(ids)), -1] = kind
    seen = text != 0
    return text[seen], seen.sum(axis=1)


@functools.cache
def decimals(n: int) -> np.ndarray:
    """Digits of 0 to n - 1, padded in front by zero bytes, and room for a sign."""
    width = len(str(max(n - 1, 0)))
    out = np.zeros((n, width + 1), np.uint8)
    for k in range(width):
        power = 10 ** (width - 1 - k)
        value = np.arange(n) // power
        out[:, k] = np.where((value > 0) | (power == 1), 48 + value % 10, 0)
    return out


def _ends(ids: np.ndarray, n: np.ndarray, size: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and lengths of tokens of the rows to keep."""
    of = np.repeat(keep, n)
    ids = ids[of]
    return ids, size[ids]


def align(texts: list[str], a: ByteTokens, b_path: str, lane: int = LANE) -> tuple[dict[str, np.ndarray], list[str], np.ndarray, np.ndarray]:
    """(n_a, n_b, n_links of each text; its groups' text hashed; A ids and B ids of all links, text by text)."""
    model = pieces_of(b_path)
    column = pa.array(texts, pa.large_string() if sum(map(len, texts)) > 1 << 29 else pa.string())
    (a_ids, n_a), (b_ids, n_b) = a.encode(column), model.encode(column)
    a_bytes = a.body
    b_bytes = _piece_bytes(b_path)
    bounds_a, bounds_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
    la, lb = a_ids.tolist(), b_ids.tolist()
    same = np.zeros(len(texts), bool)
    size = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        want = b" " + t.encode()
        same[k] = bool(t) and SIGN not in t and b"".join(map(a_bytes.__getitem__, la[bounds_a[k] : bounds_a[k + 1]])) == want and b"".join(map(b_bytes.__getitem__, lb[bounds_b[k] : bounds_b[k + 1]])) == want
        size[k] = len(want) if same[k] else 0
    a_ids, a_len = _ends(a_ids, n_a, _lengths(tuple(a_bytes)), same)
    b_ids, b_len = _ends(b_ids, n_b, _lengths(tuple(b_bytes)), same)
    n_a, n_b = np.where(same, n_a, 0), np.where(same, n_b, 0)
    edges = np.concatenate([[0], np.cumsum(size)])
    at_a, at_b = lockstep(np.cumsum(a_len), np.cumsum(b_len), *lanes(edges, lane))
    n_links = np.diff(np.searchsorted(at_a, np.concatenate([[0], np.cumsum(n_a)])))
    # the written groups: A's tokens of a group, then B's; a token's key is twice its group, and one more for B
    group_a, group_b = np.searchsorted(at_a, np.arange(len(a_ids))), np.searchsorted(at_b, np.arange(len(b_ids)))
    key = np.concatenate([2 * group_a, 2 * group_b + 1])
    order = np.argsort(key, kind="stable")
    sign = np.full(len(key), ord(","), np.uint8)
    sign[at_a] = ord("|")
    sign[len(a_ids) + at_b] = ord(";")
    data, width = written(np.concatenate([a_ids, b_ids])[order], sign[order], decimals(max(len(a_bytes), len(b_bytes))))
    ends = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(n_a + n_b)])]
    raw = data.tobytes()
    # without the sign behind the last token
    digest = [hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
    return {"n_a": n_a, "n_b": n_b, "n_links": n_links}, digest, a_ids[at_a], b_ids[at_b]


@functools.cache
def _lengths(bodies: tuple[bytes, ...]) -> np.ndarray:
    return np.fromiter(map(len, bodies), np.int64, len(bodies))


@functools.cache
def _piece_bytes(path: str) -> list[bytes]:
    library = pieces_of(path).library
    names = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) and library.is_byte(i) else p.replace(SIGN, " ").encode() for i, p in enumerate(names)]


class _Block:
    """Rows of one block: their distinct pairs, numbered, as bytes."""

    def __init__(self, name: int) -> None:
        self.name, self.rows, self.keys, self.counts, self.size = name, [], [], [], 0

    def add(self, table: pa.Table, a: np.ndarray, b: np.ndarray, n_links: np.ndarray) -> None:
        owner = np.repeat(np.arange(len(n_links)), n_links)
        pair = a.astype(np.int64) << 32 | b
        distinct, number = np.unique(pair, return_inverse=True)
        both, count = np.unique(owner * max(1, len(distinct)) + number, return_counts=True)
        self.rows.append((table, distinct[both % max(1, len(distinct))], np.bincount(both // max(1, len(distinct)), minlength=len(n_links)), count))
        self.keys.append(distinct)
        self.counts.append(np.bincount(number, minlength=len(distinct)))

    def flush(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        keys, back = np.unique(np.concatenate(self.keys), return_inverse=True)
        count = np.bincount(back, np.concatenate(self.counts), len(keys)).astype(np.int64)
        # the commonest first, so that their numbers are small
        rank = np.empty(len(keys), np.int64)
        by = np.argsort(-count, kind="stable")
        rank[by] = np.arange(len(keys))
        for table, pair, n, c in self.rows:
            number = rank[np.searchsorted(keys, pair)].astype("<i4")
            edge = np.concatenate([[0], np.cumsum(n)]).tolist()
            c = c.astype("<i4")
            cells = [(number[x:y].tobytes(), c[x:y].tobytes()) for x, y in zip(edge, edge[1:], strict=False)]
            rest = [pa.array([self.name] * len(n), pa.int64()), pa.array([x[0] for x in cells], pa.binary()), pa.array([x[1] for x in cells], pa.binary())]
            yield from pa.Table.from_arrays([*table.columns, *rest, *_nulls(len(n))], names=names).to_batches(max_chunksize=1000)
        columns = len(self.rows[0][0].columns)
        keys, count = keys[by], count[by]
        for k in range(0, len(keys), 1 << 15):
            part, sums = keys[k : k + (1 << 15)], count[k : k + (1 << 15)]
            one = np.array([len(part)])
            empty = [pa.nulls(1, f.type) for f in self.rows[0][0].schema]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([self.name]), *[pa.nulls(1, pa.binary())] * 2, pa.array([k], pa.int32()), list_column(part, one, pa.int64()), list_column(sums, one, pa.int64())], names=names)
        assert len(names) == columns + 6


def _nulls(n: int) -> list[pa.Array]:
    return [pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))]


_OWN = (("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()), ("groups_sha256", T.StringType()))


def _aligned(batches: Iterator[pa.RecordBatch], text: str, a_path: str, b_path: str, names: list[str], lane: int, limit: int) -> Iterator[pa.RecordBatch]:
    tokens, name = byte_tokens(a_path), TaskContext.get().partitionId() << 32
    block = _Block(name)
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + GROUP, "right")))
            part = batch.slice(start, end - start)
            counts, digest, a, b = align([t or "" for t in part.column(text).to_pylist()], tokens, b_path, lane)
            own = [pa.array(counts[c], pa.int64()) for c in ("n_a", "n_b", "n_links", "n_links")] + [pa.array(digest, pa.string())]
            columns = [c for c, f in zip(part.columns, part.schema, strict=True) if f.name != text]
            block.add(pa.Table.from_arrays([*columns, *own], names=names[: len(columns) + len(own)]), a, b, counts["n_links"])
            block.size += int(sizes[start:end].sum())
            start = end
            if block.size >= limit:
                yield from block.flush(names)
                name += 1
                block = _Block(name)
    yield from block.flush(names)


def _scored(docs: pa.Table, pairs: pa.Table, names: list[str], inner: tuple[str, str]) -> pa.Table:
    """Rows of one block with the sums over their links."""
    number, total, best = (pairs.column(c).to_numpy() for c in ("number", "total", "best"))
    count, top = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    count[number], top[number] = total, best
    n_best, count_sum = [], []
    for at, many in zip(*(docs.column(c).to_pylist() for c in inner), strict=True):
        at, many = np.frombuffer(at, "<i4"), np.frombuffer(many, "<i4").astype(np.int64)
        n_best.append(int((top[at] * many).sum()))
        count_sum.append(int((count[at] * many).sum()))
    kept_columns = [docs.column(k) for k in range(len(names) - 2)]
    return pa.Table.from_arrays([*kept_columns, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], names=names)


def align_documents(docs: DataFrame, a_path: str, b_path: str, text: str = "text", lane: int = LANE, block: int = BLOCK) -> DataFrame:
    """The columns of docs but for its text, with n_a, n_b, n_groups, n_links, groups_sha256, n_best (links whose pair has the highest count of its B id) and count_sum.

    a_path, b_path: vocabulary files that every worker has.
    """
    taken = [c for c in docs.columns if c != text]
    own = [T.StructField(free_name(taken, c), kind) for c, kind in _OWN]
    fields = [f for f in docs.schema.fields if f.name != text]
    for f in fields:
        f.nullable = True
    # what is between the two passes has names that no column of the input can have taken
    inner = [T.StructField(free_name(taken, c), kind) for c, kind in (("block", T.LongType()), ("pair_numbers", T.BinaryType()), ("pair_counts", T.BinaryType()), ("pair_from", T.IntegerType()), ("pair_keys", T.ArrayType(T.LongType())), ("pair_sums", T.ArrayType(T.LongType())))]
    schema = T.StructType([*fields, *own, *inner])
    names = schema.fieldNames()
    name, numbers, counts, first, keys, sums = (f.name for f in inner)
    made = kept(docs.mapInArrow(functools.partial(_aligned, text=text, a_path=a_path, b_path=b_path, names=names, lane=lane, limit=block), schema), "alignment")
    pairs = made.where(F.col(first).isNotNull()).select(F.col(name).alias("block"), F.col(first).alias("first"), F.posexplode(F.arrays_zip(F.col(keys).alias("k"), F.col(sums).alias("c"))).alias("at", "p"))
    pairs = pairs.select("block", (F.col("first") + F.col("at")).alias("number"), F.col("p.k").alias("pair"), F.col("p.c").alias("c"))
    total = pairs.groupBy("pair").agg(F.sum("c").alias("total")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    # at most a row for each id of B's vocabulary
    highest = total.groupBy("b").agg(F.max("total").alias("highest"))
    judged = total.join(F.broadcast(highest), "b").select("pair", "total", (F.col("total") == F.col("highest")).cast("long").alias("best"))
    back = pairs.select("block", "number", "pair").join(judged, "pair").select("block", "number", "total", "best")
    rows = made.where(F.col(first).isNull()).select(*[F.col(f"`{c}`") for c in taken], *[f.name for f in own], numbers, counts, name)
    out = T.StructType([*fields, *own, *[T.StructField(free_name(taken, c), T.LongType()) for c in ("n_best", "count_sum")]])
    return rows.groupBy(name).cogroup(back.groupBy("block")).applyInArrow(functools.partial(_scored, names=out.fieldNames(), inner=(numbers, counts)), out)
