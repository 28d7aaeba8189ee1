"""PII surrogates: detected entities get keyed, type-consistent replacements.

A surrogate is a keyed permutation of all strings of the entity's own format: digits stay digits, letters stay letters of their
case and script, separators stay. So two values never share a surrogate, a value has the same one everywhere, and none is its own.
Cards keep their first digit and their check-digit state, IPv4 addresses their kind, e-mail addresses their last domain label, phone numbers
a country code; given names come from the names of the same gender. ``replace`` still proves it on the data: distinct values that share a surrogate are
counted in Spark; if there are any the key is changed and the work repeated, at most ``TRIES`` times.
Spellings of one e-mail address or name in another case get one surrogate, each in its own case.

Edge cases: null and empty texts stay; overlapping matches go to the earlier and then longer one; an entity of which nothing can change
(no letters or digits) stays; repeated rows give equal results; the added columns get an underscore where the input has their names.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.llm.common import free_name

# Name lists by gender, and titles that announce a name.
FEMALE = "Alice Anna Barbara Carmen Catherine Charlotte Claire Clara Elena Elizabeth Emily Emma Eva Hannah Helen Ingrid Isabel Jane Jennifer Julia Karen Laura Linda Lucia Margaret Maria Martha Mary Nina Olivia Patricia Paula Petra Rosa Ruth Sandra Sarah Sofia Susan Teresa".split()
MALE = "Adam Andrew Anton Carlos Charles Daniel David Diego Edward Felix Frank George Hans Henry Hugo Jack James Jean John Jorge Jose Joseph Juan Karl Kevin Louis Luis Mark Martin Michael Miguel Otto Paul Pedro Peter Philip Richard Robert Thomas William".split()
TITLES = "Mr Mrs Ms Miss Dr Herr Frau Señor Señora Sr Sra Monsieur Madame Mme".split()

#: Names in capitals are found as well.
GIVEN = FEMALE + MALE + [n.upper() for n in FEMALE + MALE]
#: A word of a name with all its parts, as in Jean-Luc and O'Brien.
_PART = r"[-'’][^\W\d_]+"
_WORD = rf"[^\W\d_a-z](?:[^\W\d_]+(?:{_PART})*|(?:{_PART})+)"
_TITLED = "|".join(rf"(?<=\b{t} )|(?<=\b{t}\. )" for t in TITLES)

#: kind -> pattern, in order of precedence at one place. None of them can try one character of a text again and again.
PATTERNS = {
    "secret": r"(?:(?<=token = \")|(?<=key = \")|(?<=secret = \")|(?<=password = \"))[^\"\s]{6,}(?=\")|(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64}|AKIA[0-9A-Z]{16}|ghp_[0-9A-Za-z]{36})(?![0-9A-Za-z])",
    "email": "@",  # see _emails
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\d-])",
    "phone": r"(?<![\w.])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w.(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
    r"|(?<![\w.(])\(0\d\) ?\d{4}[ -]?\d{4}(?!\d)|(?<![\w.+-])0\d{3}[ -]\d{3}[ -]\d{3}(?![\d-])|(?<![\w.+-])0\d[ -]\d{4}[ -]\d{4}(?![\d-])",
    "name": rf"(?:{_TITLED}){_WORD}(?: {_WORD}){{0,2}}|(?<!\w)(?:{'|'.join(GIVEN)})(?:{_PART})*(?: [A-ZÀ-Þ](?:[^\W\d_]+(?:{_PART})*|(?:{_PART})+)){{1,2}}",
}
_PATTERNS = {kind: re.compile(pattern) for kind, pattern in PATTERNS.items()}
_LOCAL, _LETTER = re.compile(r"[\w.%+-]"), re.compile(r"\w")
_DOMAIN = re.compile(r"(?:[\w-]++\.)+[^\W\d_]{2,}+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses: from each @ the local part is grown to the left, no further than the last address, and the domain to the right, so no place is looked at more than a few times.

    The local part ends in no dot, and holds a letter or digit behind its last dot.
    """
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        tail = text[max(start, text.rfind(".", start, at) + 1) : at]
        domain = _DOMAIN.match(text, at + 1) if _LETTER.search(tail) else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


#: What a text needs to hold for a pattern to match; plain and fast tests that lose nothing. Digits are those of every script, as in the patterns.
DIGITS = r"\d[\d .()-]{4,}\d|\+\d[\d .()-]{3,}\d|\d\.\d+\.\d"
_DIGITS = re.compile(DIGITS)
_NEEDS = {
    "secret": lambda t: '"' in t or "AKIA" in t or "ghp_" in t or _HEX.search(t),
    "email": lambda t: "@" in t,
    "ip": _DIGITS.search,
    "ssn": _DIGITS.search,
    "card": _DIGITS.search,
    "phone": _DIGITS.search,
    "name": lambda t: any(n in t for n in _NAMED),
}
_HEX = re.compile(r"[0-9a-fA-F]{32}")
_NAMED = [f"{t} " for t in TITLES] + [f"{t}. " for t in TITLES] + GIVEN
#: Python's decimal digits as ranges, since \\d is ASCII alone in the syntax below.
_DECIMAL = "".join(f"{c}-{chr(ord(c) + 9)}" for c in map(chr, range(0x110000)) if c.isdecimal() and int(c) == 0)
#: The same for whole columns at once, in a syntax that is matched in time linear in the text.
GATE = DIGITS.replace(r"[\d", f"[{_DECIMAL}").replace(r"\d", f"[{_DECIMAL}]") + r'|@|"[^"\s]{6,}"|[0-9a-fA-F]{32}|AKIA|ghp_|\b(?:' + "|".join(TITLES) + r")\.? |(?:" + "|".join(GIVEN) + ")[-'’ ]"


#: Keys that are tried before the work is given up.
TRIES = 5


#: Characters that are permuted together at most; longer values go part by part.
LONG = 512


class Permutation:
    """A keyed permutation of range(n) without fixed points: a rotation seen through a Feistel network."""

    def __init__(self, key: bytes, label: str, n: int) -> None:
        self.n, self.key = n, hmac.digest(key, f"{label}:{n}".encode(), "sha256")
        self.half = max(1, ((n - 1).bit_length() + 1) // 2)
        self.turn = 1 + int.from_bytes(self.key[:16], "big") % (n - 1) if n > 1 else 0

    def _round(self, i: int, x: int) -> int:
        size = self.half // 8 + 1
        out = hashlib.blake2b(i.to_bytes(1, "big") + x.to_bytes(size, "big"), key=self.key, digest_size=min(64, size)).digest()
        if size > 64:
            out = hashlib.shake_256(self.key + out).digest(size)
        return int.from_bytes(out, "big") & ((1 << self.half) - 1)

    def _walk(self, x: int, rounds: range, back: bool) -> int:
        while True:  # values outside range(n) go round again
            left, right = x >> self.half, x & ((1 << self.half) - 1)
            for i in rounds:
                left, right = (right ^ self._round(i, left), left) if back else (right, left ^ self._round(i, right))
            x = left << self.half | right
            if x < self.n:
                return x

    def __call__(self, x: int) -> int:
        if self.n < 2:
            return x
        return self._walk((self._walk(x, range(6), False) + self.turn) % self.n, range(5, -1, -1), True)


@functools.cache
def _alphabet(c: str) -> str:
    """The characters that may stand for c: digits, or letters of its case and script; c alone for a separator."""
    if c.isdecimal():
        zero = ord(c) - int(c)
        return "".join(chr(zero + i) for i in range(10))
    if "a" <= c <= "z":
        return "abcdefghijklmnopqrstuvwxyz"
    if "A" <= c <= "Z":
        return "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    if not c.isalpha():
        return c
    start = ord(c) & ~0x3F  # letters of one block of 64 code points, of one case
    return "".join(x for x in map(chr, range(start, start + 64)) if x.isalpha() and x.isupper() == c.isupper() and x.islower() == c.islower())


def _permute(key: bytes, label: str, text: str, alphabets: list[str] | None = None, valid=None) -> str:
    """text through the permutation of all strings of its format; ``valid``: of those that satisfy it alone."""
    if len(text) > LONG and alphabets is None and valid is None:
        # a part after the other, each under a key that the text before it gives: going from the front, every part can be read back, so this is a permutation too
        cuts = range(0, len(text), LONG)
        return "".join(_permute(key, f"{label} {hashlib.blake2b(text[:a].encode()).hexdigest() if a else ''}", text[a : a + LONG]) for a in cuts)
    alphabets = alphabets or [_alphabet(c) for c in text]
    n = rank = 0
    n = 1
    for c, a in zip(text, alphabets, strict=True):
        rank, n = rank * len(a) + a.index(c), n * len(a)
    turn = Permutation(key, label, n)
    while True:
        rank = turn(rank)
        out, rest = [], rank
        for a in reversed(alphabets):
            rest, i = divmod(rest, len(a))
            out.append(a[i])
        made = "".join(reversed(out))
        if made == text or valid is None or valid(made):
            return made


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def ip_kind(text: str) -> str:
    a, b = map(int, text.split(".")[:2])
    return "private" if a == 10 or (a == 192 and b == 168) or (a == 172 and 16 <= b < 32) else "special" if a in (0, 127) or a >= 224 or (a == 169 and b == 254) else "public"


@functools.cache
def _heads(kind: str, a: range, b: range) -> list[tuple[int, int]]:
    """The first two parts of all addresses of a kind."""
    return [(x, y) for x in a for y in b if ip_kind(f"{x}.{y}") == kind]


def _ip(key: bytes, text: str) -> str:
    kind, parts = ip_kind(text), text.split(".")
    if text != ".".join(str(int(x)) for x in parts):
        return _ip_as_spelt(key, kind, parts)
    value = int.from_bytes(bytes(map(int, text.split("."))), "big")
    turn = Permutation(key, "ip", 1 << 32)
    while True:
        value = turn(value)
        made = ".".join(map(str, value.to_bytes(4, "big")))
        if ip_kind(made) == kind:
            return made


def _ip_as_spelt(key: bytes, kind: str, parts: list[str]) -> str:
    """Leading zeros and digits of other scripts are part of an address's format, which stays: a permutation of all of its kind and format."""
    a, b, c, d = (range(10) if len(x) > 1 and int(x) < 10 else range(10 ** (len(x) - 1) if len(x) > 1 else 0, min(256, 10 ** len(x))) for x in parts)
    heads = _heads(kind, a, b)
    rank = (heads.index((int(parts[0]), int(parts[1]))) * len(c) + int(parts[2]) - c[0]) * len(d) + int(parts[3]) - d[0]
    rest, z = divmod(Permutation(key, f"ip {kind}", len(heads) * len(c) * len(d))(rank), len(d))
    head, y = divmod(rest, len(c))
    made = zip(parts, (*heads[head], c[y], d[z]), strict=True)
    return ".".join("".join(_alphabet(old)[int(new)] for old, new in zip(x, f"{v:0{len(x)}d}", strict=True)) for x, v in made)


def _cased(like: str, text: str) -> str:
    """text in the upper and lower case of ``like``, letter by letter; what is longer takes the case of its end."""
    if like.isupper() and len(like) > 1:
        return text.upper()
    return "".join(c.upper() if like[min(i, len(like) - 1)].isupper() else c.lower() for i, c in enumerate(text))


def _any_case(key: bytes, label: str, text: str, valid=None) -> str:
    """_permute, so that spellings of one text in other cases get one surrogate in their own case. Beyond ASCII, where cases are not always pairs, case is part of the format."""
    if not text.isascii():
        return _permute(key, label, text, valid=valid)
    made = _permute(key, label, text.lower(), valid=valid)
    return "".join(m.upper() if c.isupper() else m for c, m in zip(text, made, strict=True))


def _word_of_name(key: bytes, word: str) -> str:
    for label, names in (("female", FEMALE), ("male", MALE)):
        if word.capitalize() in names and word in (word.capitalize(), word.upper(), word.lower()):
            return _cased(word, names[Permutation(key, label, len(names))(names.index(word.capitalize()))])
    listed = {n.lower() for n in FEMALE + MALE}
    return _any_case(key, "name", word, (lambda w: w.lower() not in listed) if len(word) <= max(map(len, listed)) else None)


def surrogate(key: bytes, kind: str, text: str) -> str:
    if kind == "ip":
        return _ip(key, text)
    if kind == "card":
        digits = re.sub(r"\D", "", text)
        good = luhn(digits)
        made = _permute(key, f"card{good}", digits, [digits[0], *map(_alphabet, digits[1:])], lambda d: luhn(d) == good)
        at = iter(made)
        return "".join(next(at) if c.isdigit() else c for c in text)
    if kind == "name":
        words = re.split("([-'’ ])", text)
        known = {w: _word_of_name(key, w) for w in set(words[::2])}
        return "".join(w if i % 2 else known[w] for i, w in enumerate(words))
    keep = 0
    if kind == "secret" and (head := re.match("AKIA|ghp_", text)):
        return head[0] + _permute(key, kind, text[head.end() :])
    if kind == "email":
        keep = len(text) - text.rindex(".")
    if kind == "phone" and text[0] == "+":
        head = re.match(r"\+\d{1,3}(?=[ .(-])", text)
        body = text[head.end() :] if head else text[1:]
        return text[: len(text) - len(body)] + _permute(key, "phone", body)
    body = text[: len(text) - keep]
    return (_any_case if kind == "email" else _permute)(key, kind, body) + text[len(body) :]


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the entities of a text, none of which overlap."""
    order = {kind: i for i, kind in enumerate(PATTERNS)}
    spans = lambda kind, pattern: _emails(text) if kind == "email" else (m.span() for m in pattern.finditer(text))
    found = [(start, order[kind], end, kind) for kind, pattern in _PATTERNS.items() if _NEEDS[kind](text) for start, end in spans(kind, pattern)]
    out, at = [], 0
    for start, _, end, kind in sorted(found):
        if start >= at:
            out.append((kind, start, end))
            at = end
    return out


ENTITY = "array<struct<kind: string, start: int, end: int, value: string, surrogate: string>>"
_ENTITY = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("surrogate", pa.string())]))


def _replace(batches: Iterator[pa.RecordBatch], key: bytes, text: str) -> Iterator[pa.RecordBatch]:
    known = functools.lru_cache(100_000)(functools.partial(surrogate, key))
    for batch in batches:
        column = batch.column(text)
        texts, found = column.to_pylist(), [[] for _ in range(len(column))]
        for row in np.flatnonzero(pc.fill_null(pc.match_substring_regex(column, GATE), False).to_numpy(zero_copy_only=False)).tolist():
            t, parts, at = texts[row], [], 0
            for kind, a, b in find(t):
                made = known(kind, t[a:b])
                found[row].append({"kind": kind, "start": a, "end": b, "value": t[a:b], "surrogate": made})
                parts += [t[at:a], made]
                at = b
            if parts:
                texts[row] = "".join([*parts, t[at:]])
        yield pa.RecordBatch.from_arrays([*(c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != text), pa.array(texts, pa.string()), pa.array(found, _ENTITY)], names=[*(n for n in batch.schema.names if n != text), text, "found"])


def _find(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    """The entities alone: kind, surrogate and a hash of the value, once per batch."""
    known = functools.lru_cache(100_000)(functools.partial(surrogate, key))
    for batch in batches:
        column = batch.column(0)
        hit = column.filter(pc.fill_null(pc.match_substring_regex(column, GATE), False)).to_pylist()
        seen = {(kind, t[a:b]) for t in hit for kind, a, b in find(t)}
        rows = [(kind, known(kind, v), int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "big", signed=True)) for kind, v in seen]
        if rows:
            kind, made, value = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(made), pa.array(value, pa.int64())], names=["kind", "surrogate", "v"])


def collisions(docs: DataFrame, key: bytes) -> DataFrame:
    """kind, surrogate, values: surrogates that more than one value got. Aggregated before the shuffle, so a common value is no hot key."""
    each = docs.select("text").mapInArrow(functools.partial(_find, key=key), "kind string, surrogate string, v long")
    return each.distinct().groupBy("kind", "surrogate").agg(F.count("*").alias("values")).where("values > 1")


def replace(docs: DataFrame, key: bytes, verify: bool = True) -> DataFrame:
    """``docs`` with entities replaced in text, and entities (kind, start, end, value, surrogate) added."""
    for _ in range(TRIES if verify else 0):
        if collisions(docs, key).isEmpty():
            break
        key = hashlib.sha256(key).digest()
    else:
        if verify:
            raise ValueError(f"distinct values share a surrogate under {TRIES} keys")
    made = free_name(docs.columns, "entities")
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != "text"}  # so that no input name clashes with the made ones
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()], "text")
    schema = T.StructType([*plain.schema.fields, T.StructField("found", T._parse_datatype_string(ENTITY))])
    out = plain.mapInArrow(functools.partial(_replace, key=key, text="text"), schema)
    return out.select(*[F.col(inner.get(c, "text")).alias(c) for c in docs.columns], F.col("found").alias(made))


def key_of(spark: SparkSession) -> bytes:
    """The caller's key, from the session's settings. Without one the surrogates are those of a key that everybody knows, which is for tests alone."""
    return spark.conf.get("spark.assaykit.pii.key", "a key that everybody knows").encode()
