"""A SentencePiece model as a weighted transducer: from texts to pieces and back."""

from __future__ import annotations

import re
import sys
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np

#: Kinds of pieces in a model file, and the mark of a blank: fixed values of the format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
BLANK = "▁"

#: Entries of the caches of units (and as many again from before) and of neighbouring pieces.
CACHED_UNITS, CACHED_PAIRS = 300_000, 300_000
#: Units above this length are not remembered.
LONG_UNIT = 64
#: Numbers of characters in the table of those that pieces have side by side.
TIED = 4_096
NO_PIECE, _ONLY_PREFIX = -1, -2
_NOTHING_SHORTER = -2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
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
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n


@dataclass
class PieceModel:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    kind: int = UNIGRAM
    dummy_prefix: bool = True
    squeeze_blanks: bool = True

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        """Reads the bytes of a ``.model`` file. Models with compiled character rules are refused."""
        import struct

        model = cls([], [], [])
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        (score,) = struct.unpack("<f", v)
                    elif n == 3:
                        kind = v
                model.pieces.append(piece)
                model.scores.append(score)
                model.kinds.append(kind)
            elif number == 2:
                model.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                rules = dict(_fields(value))
                if rules.get(2):
                    raise ValueError("this model's normaliser has character rules")
                model.dummy_prefix, model.squeeze_blanks = bool(rules.get(3, 1)), bool(rules.get(4, 1))
        return model


class PieceDecoder:
    """From ids back to texts: all that decoding needs."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == BYTE}
        self.bytes = {i: b for b, i in self.byte_ids.items()}
        self.text = [p.replace(BLANK, " ") if k in (NORMAL, USER_DEFINED) else "" for p, k in zip(model.pieces, model.kinds)]
        for i, kind in enumerate(model.kinds):
            if kind == UNKNOWN:
                self.text[i] = " ⁇ "

    def decode(self, ids: list[int]) -> str:
        """The text of some ids: byte pieces in a row are one UTF-8 string, and the blank put in front is taken off."""
        if self.bytes.keys().isdisjoint(ids):
            text = "".join(map(self.text.__getitem__, ids))
        else:
            parts, raw = [], bytearray()
            for i in ids:
                byte = self.bytes.get(i)
                if byte is not None:
                    raw.append(byte)
                    continue
                if raw:
                    parts.append(raw.decode(errors="replace"))
                    raw.clear()
                parts.append(self.text[i])
            text = "".join(parts) + raw.decode(errors="replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


class PieceTransducer(PieceDecoder):
    """Normaliser, pieces and byte fallback in one; ``encode`` composes it with a text and takes the shortest path.

    An arc reads a piece's characters and writes its id; a character without a piece has one arc that writes its bytes.
    Weights are tropical: along a path they are added, of two paths the smaller counts. In a unigram model an arc
    weighs minus the score of its piece. In a merge model the arcs weigh nothing, but an acceptor of neighbours is
    composed with the pieces: two pieces may follow each other only if merging their characters gives just these two
    (else the weight is infinite). One path is left then, and it is the one that merging the whole text would give.
    """

    def __init__(self, model: PieceModel):
        super().__init__(model)
        self.ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k in (NORMAL, USER_DEFINED)}
        self.unknown = next((i for i, k in enumerate(model.kinds) if k == UNKNOWN), 0)
        self._tie({p[i : i + 2] for p in self.ids for i in range(len(p) - 1)})
        self.units: dict[str, bytes] = {}
        self.old_units: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}  # by first id, second id in one number
        self.merges = model.kind == BPE
        if self.merges:
            self.split: dict[int, tuple[int, int]] = {}
            self.born: dict[int, float] = {}
            for i in sorted(self.ids.values(), key=lambda i: len(model.pieces[i])):
                self._derive(i)
            self.ids = {p: i for p, i in self.ids.items() if i in self.born}
            self.edges = [{i: self._edge(i, side) for i in self.born} for side in (0, 1)]
        # the arcs as a trie: what is only the beginning of a piece is marked
        self.arcs = {p[:k]: _ONLY_PREFIX for p in self.ids for k in range(1, len(p))} | self.ids
        # for merge models: twice the id, and one more if longer pieces begin so
        longer = {p[:-1] for p in self.arcs}
        self.steps = {p: _ONLY_PREFIX if i < 0 else 2 * i + (p in longer) for p, i in self.arcs.items()} if self.merges else {}
        # by id: the longest shorter piece that a piece begins with. The last entry is that of a character without a piece
        self.sizes = [len(p) for p in model.pieces] + [1]
        self.shorter = [_NOTHING_SHORTER] * len(self.sizes)
        for p, i in self.ids.items():
            begins = (self.ids.get(p[:k], NO_PIECE) for k in range(len(p) - 1, 0, -1))
            self.shorter[i] = next((b for b in begins if b >= 0), NO_PIECE if len(p) > 1 else _NOTHING_SHORTER)

    # -- merge models ------------------------------------------------------------------------------------------------

    def _merge(self, symbols: list[str]) -> list[tuple[str, int, int]]:
        """Merges the best pair again and again, the leftmost of equals; returns the steps as (made, left id, right id)."""
        steps = []
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                made = self.ids.get(symbols[i] + symbols[i + 1])
                if made is not None and (best is None or self.model.scores[made] > best):
                    best, at = self.model.scores[made], i
            if at < 0:
                return steps
            left, right = symbols[at], symbols[at + 1]
            steps.append((left + right, self.ids.get(left, NO_PIECE), self.ids.get(right, NO_PIECE)))
            symbols[at : at + 2] = [left + right]

    def _derive(self, i: int) -> None:
        """The last merge that makes piece ``i`` and when the piece is there: the lowest score among its merges."""
        piece = self.model.pieces[i]
        if len(piece) == 1:
            self.born[i] = float("inf")
            return
        symbols = list(piece)
        steps = self._merge(symbols)
        if len(symbols) != 1 or not steps:
            return  # merging never makes it
        _, left, right = steps[-1]
        inf = float("inf")
        self.split[i] = (left, right)
        self.born[i] = min(self.model.scores[i], self.born.get(left, inf), self.born.get(right, inf))

    def _edge(self, i: int, side: int) -> list[int]:
        """Piece ``i``, its outer half on one side, the outer half of that, and so on down to a character."""
        edge = [i]
        while (halves := self.split.get(edge[-1])) is not None:
            edge.append(halves[side])
        return edge

    def neighbours(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` side by side stay as they are: nothing merges across while both are being made."""
        if a < 0 or b < 0:  # a character without a piece never merges
            return True
        known = self.pairs.get(a << 32 | b)
        if known is not None:
            return known
        left, right = self.edges[1][a], self.edges[0][b]
        i, j = len(left) - 1, len(right) - 1
        pieces, scores, nothing = self.model.pieces, self.model.scores, float("-inf")
        while True:
            across = self.ids.get(pieces[left[i]] + pieces[right[j]])
            next_left = self.born[left[i - 1]] if i else nothing
            next_right = self.born[right[j - 1]] if j else nothing
            if across is not None and scores[across] > next_left and scores[across] >= next_right:
                stays = False
                break
            if not i and not j:
                stays = True
                break
            if i and next_left >= next_right:
                i -= 1
            else:
                j -= 1
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        self.pairs[a << 32 | b] = stays
        return stays

    # -- shortest path -----------------------------------------------------------------------------------------------

    def _shortest(self, unit: str) -> list[int]:
        """Ids along the path of least weight through the composition with ``unit``."""
        if self.merges:
            ids = self._only_path(unit)
            if ids is not None:
                return ids
            path = self._merged(unit)
        else:
            path = self._lightest_path(unit)
        return [i for piece in path for i in self._written(piece)]

    def _only_path(self, unit: str) -> list[int] | None:
        """The ids of the one path that a merge model leaves, or None.

        At most one state of the acceptor is within reach at each position, the last piece there. So the path is searched
        depth first, the longest piece first, and a position that was left once without an end needs no second visit.
        """
        n, steps, pairs, neighbours = len(unit), self.steps.get, self.pairs.get, self.neighbours
        sizes, shorter = self.sizes, self.shorter
        ids: list[int] = []
        left: set[int] = set()
        at, here = 0, NO_PIECE
        while at < n:
            end = at + 1
            step = steps(unit[at])
            piece = NO_PIECE if step is None or step < 0 else step >> 1
            if step is not None and (step & 1 or step < 0):
                while end < n:
                    end += 1
                    step = steps(unit[at:end])
                    if step is None:
                        break
                    if step >= 0:
                        piece = step >> 1
                        if not step & 1:
                            break
            while True:
                if piece == _NOTHING_SHORTER:  # nothing begins here that leads to the end
                    left.add(at)
                    if not ids:
                        return None
                    piece = ids.pop()
                    at -= sizes[piece]
                    here = ids[-1] if ids else NO_PIECE
                elif at + sizes[piece] not in left:
                    if here < 0 or piece < 0:
                        break
                    stays = pairs(here << 32 | piece)
                    if neighbours(here, piece) if stays is None else stays:
                        break
                piece = shorter[piece]
            ids.append(piece)
            at += sizes[piece]
            here = piece
        if NO_PIECE not in ids:
            return ids
        starts = accumulate((sizes[i] for i in ids), initial=0)
        return [i for start, piece in zip(starts, ids) for i in ([piece] if piece >= 0 else self._written(unit[start]))]

    def _lightest_path(self, unit: str) -> list[str]:
        """In a unigram model the state is the position alone, and weights decide."""
        n, arcs, scores = len(unit), self.arcs, self.model.scores
        no_piece = 10.0 - min(scores, default=0.0)
        best, came = [0.0] + [float("inf")] * n, [0] * (n + 1)
        for at in range(n):
            for end in range(at + 1, n + 1):
                piece = arcs.get(unit[at:end])
                if piece is None and end > at + 1:
                    break
                if piece is None or piece == _ONLY_PREFIX:
                    if end > at + 1:
                        continue
                    weight = best[at] + no_piece
                else:
                    weight = best[at] - scores[piece]
                if weight < best[end]:
                    best[end], came[end] = weight, at
                if piece is None:
                    break
        path, end = [], n
        while end:
            path.append(unit[came[end] : end])
            end = came[end]
        return path[::-1]

    def _merged(self, unit: str) -> list[str]:
        """The same by merging the whole unit, for the case that no path is left."""
        symbols = list(unit)
        self._merge(symbols)
        return symbols

    def _written(self, piece: str) -> list[int]:
        known = self.ids.get(piece)
        if known is not None:
            return [known]
        if not self.byte_ids:
            return [self.unknown]
        return [self.byte_ids[b] for b in piece.encode()]

    def _unit(self, unit: str) -> bytes:
        """Ids of a unit that is not among the last ones, as 32-bit numbers."""
        found = self.units.get(unit)
        if found is None:
            found = self.old_units.get(unit)
            if found is None:
                found = array("i", self._shortest(unit)).tobytes()
            if len(self.units) >= CACHED_UNITS:
                self.old_units, self.units = self.units, {}
            if len(unit) <= LONG_UNIT:
                self.units[unit] = found
        return found

    def forget(self) -> None:
        """Forgets the units; what is known of neighbouring pieces stays."""
        self.units, self.old_units = {}, {}

    def _tie(self, inside: set[str]) -> None:
        """Tables of the characters that some piece has side by side.

        Characters have a number as the first and one as the second of two: 0 if no piece has them there, 1 if they are
        beyond the commonest ``TIED``, which then count as tied to all but 0. That only leaves longer units.
        """
        self.first, self.second = np.zeros(sys.maxunicode + 1, np.uint16), np.zeros(sys.maxunicode + 1, np.uint16)
        for side, numbers in enumerate((self.first, self.second)):
            chars = Counter(pair[side] for pair in inside)
            for n, (char, _) in enumerate(chars.most_common(), start=2):
                numbers[ord(char)] = n if n < TIED else 1
        self.tied = np.zeros((max(2, int(self.first.max()) + 1), max(2, int(self.second.max()) + 1)), bool)
        self.tied[1, 1:] = self.tied[1:, 1] = True
        for a, b in inside:
            self.tied[self.first[ord(a)], self.second[ord(b)]] = True

    def _units(self, text: str) -> list[str]:
        """The text, cut where no piece can lie across: between two characters that no piece has side by side."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        cuts = np.flatnonzero(~self.tied[self.first[codes[:-1]], self.second[codes[1:]]]) + 1
        ends = [*cuts.tolist(), len(text)]
        return [text[start:end] for start, end in zip([0, *ends], ends)]

    def normalise(self, text: str) -> str:
        if self.model.squeeze_blanks:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (BLANK if self.model.dummy_prefix else "") + text.replace(" ", BLANK)

    def encode_array(self, text: str) -> np.ndarray:
        """Ids of a text, as int32. An empty one has none."""
        ready = self.normalise(text)
        if not ready:
            return np.empty(0, np.int32)
        units = self._units(ready)
        found = list(map(self.units.get, units))
        for i, ids in enumerate(found):
            if ids is None:
                found[i] = self._unit(units[i])
        return np.frombuffer(b"".join(found), np.int32)

    def encode(self, text: str) -> list[int]:
        return self.encode_array(text).tolist()
