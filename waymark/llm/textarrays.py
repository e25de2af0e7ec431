"""Texts of a batch as flat numpy arrays: pre-token boundaries, words, lines and their hashes.

Everything here works on one Arrow batch inside a task. A span's hash is a
polynomial over its characters, taken from running sums, so a batch costs a
fixed number of array passes whatever its words are.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np

#: Characters of text handled at a time; the arrays of a batch stay near the processor's caches.
BATCH_CHARS = 150_000

#: Hashes are polynomials over the field of this prime, at two independent bases (drawn once at random).
_PRIME = (1 << 31) - 1
_BASES = (1_148_725_973, 790_430_611)
_P, _SHIFT = np.uint64(_PRIME), np.uint64(31)
_tables: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, np.uint64), np.ones(1, np.uint64)) for _ in _BASES]


def _fold(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime, short of a last subtraction."""
    return (x & _P) + (x >> _SHIFT)


def _residue(x: np.ndarray) -> np.ndarray:
    x = _fold(_fold(x))
    return np.where(x >= _P, x - _P, x)


def _power_table(base: int, size: int) -> np.ndarray:
    table = np.ones(1, np.uint64)
    while len(table) < size:
        table = np.concatenate([table, _residue(table * np.uint64(pow(base, len(table), _PRIME)))])
    return table


def _powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the lane's base and of its inverse."""
    if len(_tables[lane][0]) < n:
        base = _BASES[lane]
        _tables[lane] = _power_table(base, n), _power_table(pow(base, -1, _PRIME), n)
    power, inverse = _tables[lane]
    return power[:n], inverse[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class Rolling:
    """Hashes of any spans of one array of character codes, by differences of running sums.

    Two spans of n characters that differ have one hash for at most (n / 2**31)**2 of
    all pairs of bases, whatever their characters are. Equal spans always have one hash.
    """

    def __init__(self, codes: np.ndarray):
        value = codes.astype(np.uint64) + np.uint64(1)
        self.lanes = []
        for lane in range(len(_BASES)):
            power, inverse = _powers(lane, len(codes) + 1)
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(_fold(value * power[:-1]), out=sums[1:])
            self.lanes.append((sums, inverse))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _joined([_residue(_residue(sums[ends] - sums[starts]) * inverse[starts]) for sums, inverse in self.lanes], ends - starts)

    def without_one(self) -> np.ndarray:
        """The hash of the whole array less one character, for each character; equal to that of the same array made anew."""
        n = len(self.lanes[0][0]) - 1
        return _joined([_residue(_residue(sums[:n]) + _residue(sums[n] - sums[1:]) * inverse[1]) for sums, inverse in self.lanes], np.full(n, n - 1))


def _joined(lanes: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """One number of the residues of both lanes (62 bits) and the length."""
    with np.errstate(over="ignore"):
        return mix(((lanes[0] << _SHIFT) | lanes[1]) + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def small_groups(texts: list[str], limit: int = BATCH_CHARS):
    """(first, after last) of runs of texts with about ``limit`` characters each."""
    first, total = 0, 0
    for i, text in enumerate(texts):
        if i > first and total + len(text) > limit:
            yield first, i
            first, total = i, 0
        total += len(text)
    if first < len(texts):
        yield first, len(texts)


# --- pre-tokens -----------------------------------------------------------------

_OTHER, _LETTER, _NUMBER, _BLANK, _SPACE = range(5)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point, from the same Unicode properties that the pattern names."""
    import regex

    table = np.full(0x110000, _OTHER, np.uint8)
    low, high = "".join(map(chr, range(0xD800))), "".join(map(chr, range(0xE000, 0x110000)))
    for name, value in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\p{White_Space}+", _BLANK)):
        for text, shift in ((low, 0), (high, 0xE000)):
            for m in regex.finditer(name, text):
                table[m.start() + shift : m.end() + shift] = value
    table[ord(" ")] = _SPACE
    return table


def pretoken_starts(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of the GPT-2 pattern begin.

    ``firsts`` are the positions at which texts begin (each text non-empty). A
    boundary depends on the classes of three neighbours and on contractions that
    start where a match starts, so no scan over matches is needed.
    """
    n = len(codes)
    kind = _classes()[codes]
    blank = kind >= _BLANK
    first = np.zeros(n + 4, bool)
    first[firsts] = True
    first[n:] = True
    before = np.empty(n, np.uint8)
    before[0] = _OTHER
    before[1:] = kind[:-1]
    first_here, first_next = first[:n], first[1 : n + 1]
    before_blank = before >= _BLANK
    after_solid = np.zeros(n, bool)
    after_solid[:-1] = ~blank[1:]
    start = np.where(
        blank,
        ~before_blank | (after_solid & ~first_next),
        np.where(before_blank, before != _SPACE, kind != before),
    )
    start |= first_here
    marks = np.flatnonzero(codes == ord("'"))
    if len(marks):
        free = first_here[marks] | ((before[marks] != _OTHER) & (before[marks] != _SPACE))
        marks = marks[free]
        ahead = np.zeros(n + 4, np.uint32)
        ahead[:n] = codes
        one, two = ahead[marks + 1], ahead[marks + 2]
        near, far = ~first[marks + 1], ~first[marks + 1] & ~first[marks + 2]
        short = near & np.isin(one, [ord(c) for c in "stmd"])
        long = far & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        wide = np.zeros(n + 4, bool)
        wide[:n] = start
        wide[marks[short] + 1] = False
        wide[marks[short] + 2] = True
        wide[marks[long] + 1] = False
        wide[marks[long] + 2] = False
        wide[marks[long] + 3] = True
        start = wide[:n] | first_here
    return np.flatnonzero(start)


def safe_cut(text: str, at: int) -> int:
    """The first place from ``at`` on where a pre-token begins whatever surrounds it, or the end.

    That is a space between two characters that are not white space.
    """
    while True:
        at = text.find(" ", at)
        if at < 0 or at + 1 >= len(text):
            return len(text)
        if at and not _is_blank(text[at - 1]) and not _is_blank(text[at + 1]):
            return at
        at += 1


def certain_starts(text: str, special: list[str] = ()) -> np.ndarray:
    """The places inside ``text`` where a pre-token begins whatever comes before or after the text.

    These are spaces between two characters that are not white space, and changes
    between letters, numbers and other characters but for those after an apostrophe;
    none lies in a string of ``special`` or where one could reach over an end of the text.
    """
    codes = codes_of(text)
    if len(codes) < 3:
        return np.empty(0, np.int64)
    kind = _classes()[codes]
    solid = kind < _BLANK
    start = np.zeros(len(codes), bool)
    start[1:] = solid[1:] & solid[:-1] & (kind[1:] != kind[:-1]) & (codes[:-1] != ord("'"))
    start[1:-1] |= (codes[1:-1] == ord(" ")) & solid[:-2] & solid[2:]
    reach = max(map(len, special), default=0)
    if reach:
        start[:reach] = False
        start[max(0, len(codes) - reach) :] = False
        for mark in special:
            at = text.find(mark)
            while at >= 0:
                start[at + 1 : at + len(mark)] = False
                at = text.find(mark, at + 1)
    return np.flatnonzero(start)


def _is_blank(c: str) -> bool:
    return _classes()[ord(c)] >= _BLANK


class WordTable:
    """What each pre-token stands for, resolved once per worker and then looked up by array.

    ``resolve`` maps a list of distinct pre-tokens to lists of integers. At most
    ``limit`` pre-tokens are held; beyond that the table starts anew, so memory is
    bounded and results do not change. Hits are compared character by character,
    so equal hashes of different words cannot pass for one another.
    """

    def __init__(self, resolve, limit: int = 500_000):
        self.resolve, self.limit = resolve, limit
        self._clear()

    def _clear(self) -> None:
        self.keys, self.rows = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.values, self.value_at = np.empty(0, np.int32), np.zeros(1, np.int64)
        self.letters, self.letter_at = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _add(self, keys: np.ndarray, words: list[str]) -> None:
        found = self.resolve(words)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum()))
        self.values = np.concatenate([self.values, flat])
        self.value_at = np.concatenate([self.value_at, self.value_at[-1] + np.cumsum(lengths)])
        self.letters = np.concatenate([self.letters, codes_of("".join(words))])
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.letter_at = np.concatenate([self.letter_at, self.letter_at[-1] + np.cumsum(sizes)])
        rows = np.arange(len(self.rows), len(self.rows) + len(keys))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.rows = np.insert(self.keys, at, keys), np.insert(self.rows, at, rows)

    def look_up(self, text: str, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The row of each pre-token of ``text``."""
        ends = np.append(starts[1:], len(codes))
        found, first, back = np.unique(Rolling(codes).spans(starts, ends), return_index=True, return_inverse=True)
        for fresh in (False, True):
            at = np.minimum(np.searchsorted(self.keys, found), max(len(self.keys) - 1, 0))
            new = self.keys[at] != found if len(self.keys) else np.ones(len(found), bool)
            if not new.any():
                break
            if not fresh and len(self.keys) + int(new.sum()) > self.limit:
                self._clear()
                new[:] = True
            self._add(found[new], [text[starts[i] : ends[i]] for i in first[new].tolist()])
        rows = self.rows[at][back]
        held = np.repeat(self.letter_at[rows] - starts, ends - starts) + np.arange(len(codes))
        if not (np.array_equal(self.letter_at[rows + 1] - self.letter_at[rows], ends - starts) and np.array_equal(self.letters[held], codes)):
            self._clear()
            raise HashClash
        return rows

    def values_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The integers of all rows, end to end, and how many each row has."""
        counts = self.value_at[rows + 1] - self.value_at[rows]
        upto = np.cumsum(counts)
        at = np.repeat(self.value_at[rows] - (upto - counts), counts) + np.arange(int(upto[-1]) if len(upto) else 0)
        return self.values[at], counts


class HashClash(Exception):
    """Two different words with one hash."""


def look_up_texts(table: WordTable, texts: list[str], special: dict[str, int] | None = None) -> list[np.ndarray]:
    """The integers of every text, its pre-tokens resolved by ``table``.

    Occurrences of the strings in ``special`` stand for their own integer, and the
    text on either side is split on its own, as the tokenizers library does by default.
    """
    parts: list[str] = []
    plan: list[list] = []
    for text in texts:
        pieces: list = [text]
        for mark, value in (special or {}).items():
            if mark in text:
                pieces = [y for x in pieces for y in (_parted(x, mark, value) if isinstance(x, str) else [x])]
        own = []
        for x in pieces:
            if isinstance(x, str):
                at = 0
                while at < len(x):
                    end = safe_cut(x, at + BATCH_CHARS) if len(x) - at > BATCH_CHARS else len(x)
                    own.append((len(parts), None))
                    parts.append(x[at:end])
                    at = end
            else:
                own.append((-1, x))
        plan.append(own)
    values: list = [None] * len(parts)
    for a, b in small_groups(parts):
        for i, v in zip(range(a, b), _values(table, parts[a:b]), strict=True):
            values[i] = v
    out = []
    for own in plan:
        arrays = [values[i] if i >= 0 else np.array([x], np.int32) for i, x in own]
        out.append(arrays[0] if len(arrays) == 1 else np.concatenate([np.empty(0, np.int32), *arrays]))
    return out


def _parted(text: str, mark: str, value: int) -> list:
    out: list = []
    for i, x in enumerate(text.split(mark)):
        out += [value] * (i > 0) + [x] * bool(x)
    return out


def _values(table: WordTable, parts: list[str]) -> list[np.ndarray]:
    text = "".join(parts)
    codes = codes_of(text)
    firsts = np.cumsum([0, *map(len, parts)])[:-1]
    starts = pretoken_starts(codes, firsts)
    try:
        values, counts = table.values_of(table.look_up(text, codes, starts))
    except HashClash:
        if len(parts) > 1:
            return [v for p in parts for v in _values(table, [p])]
        ends = [*starts[1:].tolist(), len(text)]
        return [np.array([x for w in table.resolve([text[a:b] for a, b in zip(starts.tolist(), ends, strict=True)]) for x in w], np.int32)]
    upto = np.concatenate([[0], np.cumsum(counts)])
    edges = upto[np.searchsorted(starts, np.append(firsts, len(codes)))]
    return [values[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
