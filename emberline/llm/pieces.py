"""SentencePiece BPE models: the file, its normaliser, and exact encoding by dynamic programming.

Encoding rests on a property of BPE: a sequence of pieces is the encoding of its text exactly
if each two neighbours are the encoding of theirs. So the last piece of each prefix's encoding
follows from earlier prefixes, which gives every prefix's token count in one pass, and the
encoding itself by walking back. Texts are cut first where no piece can reach across.
"""

from __future__ import annotations

import re
import struct
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
LONG = 64  # units over this many characters are not kept in caches


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message; sub-messages and strings as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size = varint()
            yield tag >> 3, data[at : at + size]
            at += size


class CharMap:
    """A compiled character map: a double-array trie of UTF-8 prefixes, and their replacements."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, length) of the longest mapped prefix of ``text[at:]``, if there is one."""
        if not self.units:
            return None
        found = None
        unit = self.units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != text[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = self.units[node] & 0x7FFFFFFF, k + 1 - at
        if found is None:
            return None
        begin, length = found
        return self.strings[begin : self.strings.index(b"\0", begin)], length


class PieceModel:
    """A BPE model with byte fallback, read from a ``.model`` file.

    Raises ``ValueError`` for other model types and for user-defined or unused pieces.
    """

    def __init__(self, path: str, data: bytes | None = None) -> None:
        if data is None:
            with open(path, "rb") as file:
                data = file.read()
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        trainer: dict[int, int | bytes] = {}
        norm: dict[int, int | bytes] = {}
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                piece, kind = own[1].decode(), own.get(3, NORMAL)
                if kind not in (NORMAL, UNKNOWN, CONTROL, BYTE):
                    raise ValueError(f"piece {piece!r} has unsupported type {kind}")
                if kind == NORMAL:
                    self.ids[piece] = len(self.pieces)
                    self.scores[piece] = struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0]
                self.pieces.append(piece)
                self.kinds.append(kind)
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                norm = dict(fields(value))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0):
            raise ValueError("not a BPE model with byte fallback and leading white space marks")
        self.bos, self.eos = trainer.get(41, 1), trainer.get(42, 2)
        self.char_map = CharMap(norm.get(2, b""))
        self.prefix, self.squeeze, self.escape = bool(norm.get(3, 1)), bool(norm.get(4, 1)), bool(norm.get(5, 1))
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.id_bytes = {i: b for b, i in self.byte_ids.items()}
        self.first_byte, self.last_byte = min(self.id_bytes), max(self.id_bytes)
        self.longest = max(map(len, self.ids))
        self.plain = not self.char_map.units and not self.squeeze and self.prefix and self.escape
        self.cut = re.compile(_cut_pattern([p for p in self.ids if len(p) > 1]))
        self._pairs: dict[int, bool] = {}

    # -- normalisation ---------------------------------------------------------------------

    def normalised(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised text, alignment): byte k of it comes from source bytes from ``alignment[k]`` on.

        Bytes that stay as they are align one to one, all those of a replacement with its beginning.
        The alignment has one entry more than the text, the end of the source read.
        """
        mark = SPACE.encode() if self.escape else b" "
        if text and not self.char_map.units and not self.squeeze:  # no prefix of anything is in the map: only blanks change
            lengths = np.ones(len(text) + 1, np.int64)
            lengths[:-1][np.frombuffer(text, np.uint8) == 0x20] = len(mark)
            lead = mark if self.prefix else b""
            return lead + text.replace(b" ", mark), np.concatenate([np.zeros(len(lead), np.int64), np.repeat(np.arange(lengths.size), lengths)])
        out, origin, at = bytearray(), [], 0
        if self.squeeze:
            while at < len(text):
                part, size = self._prefix(text, at)
                if part != b" ":
                    break
                at += size
        if at == len(text):
            return b"", np.array([at], np.int64)
        if self.prefix:
            out += mark
            origin += [at] * len(mark)
        after_space = self.squeeze
        while at < len(text):
            part, size = self._prefix(text, at)
            if after_space:
                part = part.lstrip(b" ")
            same = part == text[at : at + size]
            for k, byte in enumerate(part):
                new = mark if byte == 0x20 else bytes((byte,))
                out += new
                origin += [at + k if same else at] * len(new)
            if part:
                after_space = part.endswith(b" ")
            at += size
            if not self.squeeze:
                after_space = False
        if self.squeeze:
            while out.endswith(mark):
                at = origin[len(out) - len(mark)]
                del out[-len(mark) :], origin[-len(mark) :]
        return bytes(out), np.array([*origin, at], np.int64)

    def _prefix(self, text: bytes, at: int) -> tuple[bytes, int]:
        mapped = self.char_map.longest(text, at)
        if mapped:
            return mapped
        head = text[at]
        size = 1 if head < 0x80 else 2 if head < 0xE0 else 3 if head < 0xF0 else 4
        return text[at : at + size], size

    # -- encoding --------------------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """The encoding by its definition: the best-scored neighbours merge first, leftmost on ties."""
        parts, score, none = list(text), self.scores.get, float("-inf")
        scores = [score(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while scores:
            best = max(scores)
            if best == none:
                break
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at < len(scores):
                scores[at] = score(parts[at] + parts[at + 1], none)
            if at:
                scores[at - 1] = score(parts[at - 1] + parts[at], none)
        return parts

    def neighbours(self, left: int, right: int) -> bool:
        """Whether the pieces with these ids are the encoding of their concatenation; ``left`` 0 stands for no piece."""
        known = self._pairs.get(left << 20 | right)
        if known is None:
            if len(self._pairs) > 1_000_000:
                self._pairs.clear()
            pieces = [self.pieces[left], self.pieces[right]] if left else [self.pieces[right]]
            known = self._pairs[left << 20 | right] = self.merged("".join(pieces)) == pieces
        return known

    def prefixes(self, unit: str, state: tuple[list[int], list[int], list[int]] | None = None) -> tuple[list[int], list[int], list[int]]:
        """(counts, sizes, last) by prefix of ``unit``: its token count, and the length and id of its encoding's last piece.

        A character without a piece merges with nothing; it has id 0, as what comes before the
        unit has. Only one last piece fits, so the likely ones are tried first: the last
        piece before with this character added, and this character alone. A ``state`` passed in
        holds what is known of the first prefixes and is extended.
        """
        find, pairs, check, most = self.ids.get, self._pairs.get, self.neighbours, self.longest
        counts, sizes, last = state or ([0], [0], [0])
        for end in range(len(counts), len(unit) + 1):
            alone = find(unit[end - 1])
            if alone is None:
                counts.append(counts[end - 1] + len(unit[end - 1].encode()))
                sizes.append(1)
                last.append(0)
                continue
            size = sizes[end - 1] + 1
            piece = find(unit[end - size : end]) if last[end - 1] else None
            if piece is not None:
                fits = pairs(last[end - size] << 20 | piece)
                if fits is None:
                    fits = check(last[end - size], piece)
            if piece is None or not fits:
                size, piece = 1, alone
                fits = pairs(last[end - 1] << 20 | piece)
                if fits is None:
                    fits = check(last[end - 1], piece)
            if not fits:
                for size in range(min(most, end), 1, -1):
                    piece = find(unit[end - size : end])
                    if piece is not None and check(last[end - size], piece):
                        break
                else:
                    raise ValueError(f"no encoding of {unit[:end]!r}")
            counts.append(counts[end - size] + 1)
            sizes.append(size)
            last.append(piece)
        return counts, sizes, last

    def prefix_counts(self, units: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """(unit, counts) as by ``prefixes``, in sorted order: a unit starts from what it shares with the one before."""
        state, before = ([0], [0], [0]), ""
        for unit in sorted(units):
            same, most = 0, min(len(unit), len(before))
            while same < most and unit[same] == before[same]:
                same += 1
            for known in state:
                del known[same + 1 :]
            self.prefixes(unit, state)
            before = unit
            yield unit, state[0]

    def unit_pieces(self, unit: str, short: int = 200) -> list[str]:
        """The encoding of a unit, a character without a piece standing for itself.

        Up to ``short`` characters merging is the quicker way; beyond it is quadratic.
        """
        if len(unit) <= short:
            return self.merged(unit)
        sizes = self.prefixes(unit)[1]
        out, end = [], len(unit)
        while end:
            out.append(unit[end - sizes[end] : end])
            end -= sizes[end]
        return out[::-1]

    def piece_ids(self, piece: str) -> list[int]:
        known = self.ids.get(piece)
        return [known] if known is not None else [self.byte_ids[b] for b in piece.encode()]

    def units(self, text: str) -> list[str]:
        """The normalised form of ``text`` cut into units that encode independently; empty for an empty text."""
        if not text:
            return []
        if self.plain:
            return self.cut.findall(SPACE + text.replace(" ", SPACE))
        return self.cut.findall(self.normalised(text.encode())[0].decode())

    # -- decoding --------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: control pieces are empty, each byte that is not UTF-8 becomes U+FFFD."""
        out, run, begun = [], bytearray(), False
        for i in [*ids, -1]:
            byte = self.id_bytes.get(i)
            if byte is not None:
                run.append(byte)
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run, begun = bytearray(), True
            if i < 0 or self.kinds[i] == CONTROL:
                continue
            piece = self.pieces[i] if self.kinds[i] != UNKNOWN else " ⁇ "
            if not begun and (self.prefix or self.squeeze) and piece.startswith(SPACE):
                piece = piece[1:]
                begun = not self.squeeze
            begun = begun or bool(piece)
            out.append(piece.replace(SPACE, " "))
        return "".join(out)


def _utf8(data: bytes) -> str:
    """``data`` as UTF-8, each byte outside a whole character as U+FFFD."""
    out, at = [], 0
    while at < len(data):
        head = data[at]
        size = 1 if head < 0x80 else 2 if 0xC2 <= head < 0xE0 else 3 if 0xE0 <= head < 0xF0 else 4 if 0xF0 <= head < 0xF5 else 0
        try:
            out.append(data[at : at + size].decode() if size and at + size <= len(data) else "�")
        except UnicodeDecodeError:
            size = 0
            out.append("�")
        at += size or 1
    return "".join(out)


def _cut_pattern(joined: list[str]) -> str:
    """A pattern for the units of a text: no piece of ``joined`` reaches across where one ends.

    A mark of white space only ever begins a piece; line ends and tabs stand alone; and the
    signs (characters that are no letters) that share no piece with others run by themselves.
    """
    if any(SPACE in p.lstrip(SPACE) for p in joined):
        return r"(?s:.+)"
    alone = "".join(c for c in "\n\t\r" if not any(c in p for p in joined))
    bare = [set(p.lstrip(SPACE)) for p in joined]
    signs = {c for p in bare for c in p if unicodedata.category(c)[0] in "NPSC"} | set("#$%&()*+,-./:;<=>?@[]^_{|}~!\"'")
    while mixed := {c for p in bare if p & signs and p - signs for c in p & signs}:
        signs -= mixed
    run = "".join(map(re.escape, sorted(signs)))
    parts = [f"{SPACE}*[^{SPACE}{alone}{run}]+"]
    if run:
        parts.append(f"{SPACE}*[{run}]+")
    parts.append(f"{SPACE}+")
    if alone:
        parts.append(f"[{alone}]")
    return "|".join(parts)


class UnitCache(dict):
    """Units seen lately with what ``make`` gives for them, two generations of at most ``most`` in all."""

    def __init__(self, make: Callable, most: int = 1_200_000) -> None:
        super().__init__()
        self.make, self.most = make, most
        self.older: dict = {}

    def __missing__(self, unit: str):
        value = self.older.get(unit)
        if value is None:
            value = self.make(unit)
            if len(unit) > LONG:
                return value
        self.keep(unit, value)
        return value

    def keep(self, unit: str, value) -> None:
        if len(self) >= self.most // 2:
            self.older = dict(self)
            self.clear()
        self[unit] = value


@lru_cache(maxsize=4)
def load(path: str) -> PieceModel:
    """The model of a file, read once per process."""
    return PieceModel(path)


def packed(values: list[int]) -> bytes:
    """``values`` as little-endian unsigned 32-bit integers."""
    out = array("I", values)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


@lru_cache(maxsize=4)
def id_cache(path: str) -> UnitCache:
    """Unit -> its ids as little-endian unsigned 32-bit integers, per process."""
    model = load(path)
    return UnitCache(lambda unit: packed([i for p in model.unit_pieces(unit) for i in model.piece_ids(p)]))
