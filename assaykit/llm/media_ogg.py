"""Media columns in Ogg: 8-bit samples in, one container per row out, and back.

``encode`` writes logical streams whose pages are interleaved by time: the samples, in packets of ``PACKET`` samples, every eighth of ``LARGE`` samples
(more than a page holds); an envelope with the loudest sample of each of those packets, eight to a packet; and a note, if there is one. ``decode``
reads any such container: it verifies each page's checksum, demultiplexes the streams by serial number, puts packets together
from lacing values across pages, derives timestamps from granule positions (a page's granule position is the number of
samples up to the end of the last packet that ends on it), and holds the envelope against the samples.

Edge cases: null samples or media give null; no samples give a stream without data packets; a container that is cut, damaged
or out of sequence gives its fault in ``error`` and no samples, never an exception.
"""

from __future__ import annotations

import functools
import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from assaykit.llm.common import free_name

RATE, PACKET, LARGE, GROUP = 8000, 4000, 66_000, 8
#: Fixed values of the container format: capture pattern, header flags, most segments of a page.
CAPTURE, CONTINUED, FIRST, LAST, SEGMENTS = b"OggS", 1, 2, 4, 255
HEAD = struct.Struct("<4sBBqIIIB")
NO_PACKET_ENDS = -1

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(data: bytes) -> int:
    """The container's checksum: polynomial 0x04c11db7, most significant bit first, start and end value 0.

    zlib's runs over the same polynomial with the least significant bit first, so the bits are turned around before and after.
    """
    reflected = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REVERSED), "big")


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    raw = HEAD.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return raw[:22] + page_crc(raw).to_bytes(4, "little") + raw[26:]


def stream_pages(packets: list[tuple[bytes, int]], serial: int, alone: bool = False) -> Iterator[tuple[int, bytes]]:
    """packets with the granule position at each one's end -> (time, page); the first packet has a page of its own, with ``alone`` each has.

    A packet that is more than the rest of a page holds goes on in the next one. The time of a page is where its last packet ends, or the one that it holds a part of.
    """
    number, flags, lacing, body, granule = 0, FIRST, bytearray(), [], NO_PACKET_ENDS
    for k, (packet, at) in enumerate(packets):
        done = 0
        sizes = bytes([255]) * (len(packet) // 255) + bytes([len(packet) % 255])
        while sizes:
            room = SEGMENTS - len(lacing)
            part, sizes = sizes[:room], sizes[room:]
            lacing += part
            body.append(packet[done : done + sum(part)])
            done += sum(part)
            if not sizes:
                granule = at
            ends = not sizes and (alone or k in (0, len(packets) - 1))
            if ends or len(lacing) == SEGMENTS:
                last = LAST if not sizes and k == len(packets) - 1 else 0
                yield at, page(flags | last, granule, serial, number, bytes(lacing), b"".join(body))
                number, flags, lacing, body, granule = number + 1, CONTINUED if sizes else 0, bytearray(), [], NO_PACKET_ENDS


def packet_ends(size: int) -> list[int]:
    """Where each packet of so many samples ends."""
    out = [0]
    while out[-1] < size:
        out.append(min(size, out[-1] + (LARGE if len(out) % GROUP == 0 else PACKET)))
    return out[1:]


def envelope(samples: bytes, ends: list[int]) -> list[tuple[bytes, int]]:
    """The greatest distance from the middle within each packet, GROUP packets together, with where they end."""
    wave = np.abs(np.frombuffer(samples, np.uint8).astype(np.int16) - 128).astype(np.uint8)
    peaks = np.maximum.reduceat(wave, [0, *ends[:-1]]).tobytes() if ends else b""
    return [(peaks[i : i + GROUP], ends[min(i + GROUP, len(ends)) - 1]) for i in range(0, len(ends), GROUP)]


def encode_bytes(samples: bytes, note: bytes = b"", rate: int = RATE) -> bytes:
    serial, ends = zlib.crc32(samples), packet_ends(len(samples))
    sound = [(b"\x01samples" + struct.pack("<IQ", rate, len(samples)), 0), *((samples[a:b], b) for a, b in zip([0, *ends], ends, strict=False))]
    streams = [stream_pages(sound, serial), stream_pages([(b"\x01envelope", 0), *envelope(samples, ends)], serial ^ 0xFFFFFFFF, alone=True)]
    if note:
        streams.append(stream_pages([(b"\x01note", 0), (note, 0)], serial ^ 0x55555555))
    heads = [next(pages)[1] for pages in streams]  # all first pages come before any other
    return b"".join([*heads, *(made for _, made in heapq.merge(*streams, key=lambda x: x[0]))])


def demultiplex(media: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """serial -> packets, each with the granule position of the page that it ends on. Raises ValueError on any fault."""
    streams: dict[int, list[tuple[bytes, int]]] = {}
    state: dict[int, list] = {}  # next page number, parts of an open packet, whether the stream has ended
    at = 0
    while at < len(media):
        if len(media) < at + HEAD.size or media[at : at + 4] != CAPTURE:
            raise ValueError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, crc, count = HEAD.unpack_from(media, at)
        lacing = media[at + HEAD.size : at + HEAD.size + count]
        body = at + HEAD.size + count
        end = body + sum(lacing)
        if version or end > len(media) or len(lacing) < count:
            raise ValueError(f"page at byte {at} is cut or of an unknown version")
        if page_crc(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != crc:
            raise ValueError(f"checksum of the page at byte {at}")
        if flags & FIRST:
            if serial in state:
                raise ValueError(f"stream {serial} begins twice")
            state[serial], streams[serial] = [0, [], False], []
        held = state.get(serial)
        if held is None or held[2] or held[0] != number or bool(flags & CONTINUED) != bool(held[1]):
            raise ValueError(f"page at byte {at} is out of sequence")
        held[0] += 1
        size = 0
        for value in lacing:
            size += value
            if value < 255:
                streams[serial].append((b"".join([*held[1], media[body : body + size]]), granule))
                held[1], body, size = [], body + size, 0
        if size or (count and lacing[-1] == 255):
            held[1].append(media[body : body + size])
        held[2] = bool(flags & LAST)
        at = end
    if not state or not all(h[2] for h in state.values()):
        raise ValueError("a stream doesn't end")
    return streams


def sound_feature(samples: bytes, rate: int) -> str:
    """Length, mean, loudness, peak and sign changes of 8-bit samples around their middle, 128."""
    wave = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    if not len(wave):
        return "us=0"
    crossings = int(((wave[1:] < 0) != (wave[:-1] < 0)).sum())
    return f"us={len(wave) * 1_000_000 // rate};mean={wave.sum() / len(wave):.6f};rms={np.sqrt((wave * wave).sum() / len(wave)):.6f};peak={np.abs(wave).max()};crossings={crossings}"


def decode_bytes(media: bytes) -> dict:
    """samples, note, rate, duration_us, packet_us (the end time of each data packet), streams, error."""
    none = {"samples": None, "note": None, "rate": None, "duration_us": None, "packet_us": None, "streams": None, "feature": None}
    try:
        streams = demultiplex(media)
        sound = next((p for p in streams.values() if p[0][0].startswith(b"\x01samples")), None)
        note = next((p for p in streams.values() if p[0][0] == b"\x01note"), None)
        peaks = next((p for p in streams.values() if p[0][0] == b"\x01envelope"), None)
        if sound is None:
            raise ValueError("no stream of samples")
        rate, length = struct.unpack_from("<IQ", sound[0][0], 8)
        samples = b"".join(p for p, _ in sound[1:])
        if len(samples) != length or sound[-1][1] != length or not rate:
            raise ValueError("the last granule position isn't the number of samples")
        # a page's granule position is that of its last packet; earlier packets on it end by their sizes
        ends = np.cumsum([len(p) for p, _ in sound[1:]]).tolist()
        if any(e > g for e, (_, g) in zip(ends, sound[1:], strict=True)):
            raise ValueError("a granule position is before its packets' end")
        if peaks is not None and peaks[1:] != envelope(samples, ends):
            raise ValueError("the envelope isn't that of the samples")
    except (ValueError, struct.error) as fault:
        return none | {"error": str(fault)}
    return {"samples": samples, "note": note[1][0] if note and len(note) > 1 else None, "rate": rate, "duration_us": length * 1_000_000 // rate, "packet_us": [e * 1_000_000 // rate for e in ends], "streams": len(streams), "feature": sound_feature(samples, rate), "error": None}


DECODED = T.StructType([
    T.StructField("samples", T.BinaryType()), T.StructField("note", T.BinaryType()), T.StructField("rate", T.LongType()), T.StructField("duration_us", T.LongType()),
    T.StructField("packet_us", T.ArrayType(T.LongType())), T.StructField("streams", T.LongType()), T.StructField("feature", T.StringType()), T.StructField("error", T.StringType()),
])
_DECODED = pa.struct([("samples", pa.binary()), ("note", pa.binary()), ("rate", pa.int64()), ("duration_us", pa.int64()), ("packet_us", pa.list_(pa.int64())), ("streams", pa.int64()), ("feature", pa.string()), ("error", pa.string())])


def _map(batches: Iterator[pa.RecordBatch], column: str, made: str, kind: pa.DataType, work) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = pa.array([None if x is None else work(x) for x in batch.column(column).to_pylist()], kind)
        yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, made])


def encode(df: DataFrame, samples: str = "samples", media: str = "media") -> DataFrame:
    """df with the binary column ``samples`` stored as Ogg in ``media``."""
    media = free_name(df.columns, media)
    schema = T.StructType([*df.schema.fields, T.StructField(media, T.BinaryType())])
    return df.mapInArrow(functools.partial(_map, column=samples, made=media, kind=pa.binary(), work=encode_bytes), schema)


def decode(df: DataFrame, media: str = "media", decoded: str = "decoded") -> DataFrame:
    """df with the binary column ``media`` read back into the struct ``decoded``."""
    decoded = free_name(df.columns, decoded)
    schema = T.StructType([*df.schema.fields, T.StructField(decoded, DECODED)])
    return df.mapInArrow(functools.partial(_map, column=media, made=decoded, kind=_DECODED, work=decode_bytes), schema)
