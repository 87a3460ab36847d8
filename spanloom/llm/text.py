"""Words and pieces of whole batches of texts, as 64-bit names, with NumPy.

A batch is joined, decoded to code points once and cut by a lookup table of character
classes, so that no Python code runs per word. The name of a word is a polynomial hash of
its code points modulo 2**64, scrambled; the same word has the same name on every executor.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Characters of the texts that are turned into arrays at a time; only memory depends on it.
CHUNK_CHARS = 1_000_000


@cache
def word_class() -> np.ndarray:
    """True for the code points of general categories L and N."""
    table = np.zeros(sys.maxunicode + 1, dtype=bool)
    for plane in (range(0x40000), range(0xE0000, 0xE0200)):
        for c in plane:
            table[c] = unicodedata.category(chr(c))[0] in "LN"
    return table


@cache
def piece_class() -> np.ndarray:
    """True for all but space, tab, line feed and carriage return."""
    table = np.ones(sys.maxunicode + 1, dtype=bool)
    table[[9, 10, 13, 32]] = False
    return table


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_CHARS + 4096), base, dtype=U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 4 * CHUNK_CHARS:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scrambles all bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def named(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, str]:
    """(names, starts, ends, bounds, joined): the maximal runs of table's characters in all
    texts. starts and ends are character positions in joined; the runs of text i are those
    with numbers bounds[i] up to bounds[i + 1]."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = np.zeros(len(points) + 2, dtype=np.int8)
    inside[1:-1] = table[points]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(points) + 1, dtype=U64)
    weighted = points.astype(U64)
    weighted += U64(0x51ED270B)
    weighted *= _power(_BASE, len(points))
    np.cumsum(weighted, out=sums[1:])
    names = mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(points) + 1)[starts])
    firsts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lengths + 1, out=firsts[1:])
    return names, starts, ends, np.searchsorted(starts, firsts), joined


def plain_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(names, bounds) of the plain words: lower case, runs of letters and digits."""
    names, _, _, bounds, _ = named([t.lower() for t in texts], word_class())
    return names, bounds


def pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(names, bounds) of the pieces: runs of what is no space, tab, LF or CR."""
    names, _, _, bounds, _ = named(texts, piece_class())
    return names, bounds


def windows(names: np.ndarray, width: int) -> np.ndarray:
    """The name of each window of width names, by its first; windows cross text bounds."""
    n = max(0, len(names) - width + 1)
    out = np.zeros(n, dtype=U64)
    for j in range(width):
        out *= U64(_BASE)
        out += names[j : j + n]
    return mix(out)


def chunks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[list, ...]]:
    """Lists of the columns' values, text last, in chunks of about CHUNK_CHARS characters."""
    for batch in batches:
        values = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        texts = values[-1].to_pylist()
        rest = [v.to_pylist() for v in values[:-1]]
        at = size = 0
        for i, t in enumerate(texts):
            size += len(t) if t is not None else 0
            if size >= CHUNK_CHARS or i + 1 == len(texts):
                yield (*(r[at : i + 1] for r in rest), texts[at : i + 1])
                at, size = i + 1, 0


def positions_in(bounds: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the runs at which a window of width runs starts that stays in its text."""
    sizes = np.diff(bounds)
    room = np.maximum(sizes - width + 1, 0)
    total = int(room.sum())
    before = np.repeat(np.cumsum(room) - room, room)
    return np.arange(total) - before + np.repeat(bounds[:-1], room)
