"""The order of all suffixes by their tokens, as packed arrays.

The stream is cut into blocks of packed text. A suffix goes with its first tokens to a range of the
order; a range sorts them and keeps places, not tokens. Suffixes that agree in these tokens fetch
further ones from the blocks, more of them each round, until few or none are left. Rows hold whole
arrays, so that no row is made for a suffix before the result. The ranges are shuffled in passes,
which bounds the disk that it takes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.config import TokenFormat
from spanloom.operators.corpus import stream
from spanloom.session import materialize

#: Positions of a block of text, and the tokens behind its end that it holds besides.
BLOCK, AHEAD = 1 << 17, 4096
#: Tokens that suffixes are sorted by first, and those of the first round after that.
HEAD, STEP = 8, 16
#: Suffixes of a range, and of a pass.
RANGE_ROWS, PASS_ROWS = 500_000, 6_000_000
#: Passes at most: beyond that a pass has more suffixes, a share of the disk that all would take.
PASSES = 5
#: Suffixes that a task sends at a time.
SENT_ROWS = 150_000
#: Sampled suffixes for each range.
SAMPLES = 200


def packed(values: np.ndarray) -> bytes:
    """An array in byte planes, compressed: small or sorted numbers take little."""
    if not len(values):
        return bytes(8)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    if not size:
        return np.empty(0, dtype=kind)
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True), dtype=np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).reshape(-1).view(kind)


def column(batch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _keep_memory() -> None:
    """Have this process keep what its arrays gave back: fetching it anew from the system for each
    array takes longer than working on it. Where the C library has no such setting nothing changes."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 30)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 28)  # M_TRIM_THRESHOLD
    except (AttributeError, OSError):
        pass


def _top(docs: DataFrame) -> int:
    return docs.agg(F.max(F.array_max("toks"))).first()[0] or 0


def token_bytes(top: int) -> int:
    """Bytes that tell the tokens up to top apart: of an id's bytes, least first, the leading ones, with
    room for adding one to the last of them."""
    return next(n for n in range(1, 9) if top < 1 << (8 * n - 1))


def token_bits(top: int, width: int) -> int:
    """Bits of a code of such a token: the last byte takes what its values, the end of the stream and
    the separator need."""
    return 8 * (width - 1) + ((top >> 8 * (width - 1)) + 2).bit_length()


@dataclass
class Blocks:
    """table: (block, n, text); of each block the packed tokens of its n positions and of what
    comes behind. The end of the stream is 0, the separator has only set bits. inside: only what lies
    inside documents counts, and positions are kept of suffixes alone that have to be sorted further."""

    table: DataFrame
    width: int
    ranks: int
    bits: int
    top: int = 0
    head: int = HEAD
    inside: bool = False
    range_rows: int = field(default_factory=lambda: RANGE_ROWS)
    pass_rows: int = field(default_factory=lambda: PASS_ROWS)


def blocks(docs: DataFrame, fmt: TokenFormat, head: int = HEAD) -> Blocks:
    width, block, ahead = token_bytes(top := _top(docs)), BLOCK, AHEAD

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("toks"))
            sizes = lists.value_lengths().to_numpy()
            raw = lists.flatten().to_numpy().astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].copy()
            raw[:, -1] += 1
            raw = raw.tobytes()
            out, done = ([], [], []), 0
            for first, n in zip(column(batch, "first"), sizes.tolist()):
                text = b"\xff" * width + raw[done * width : (done + n) * width]
                done += n
                for b in range(max(0, first - ahead) // block, (first + n) // block + 1):
                    begin, end = max(first, b * block), min(first + n + 1, (b + 1) * block + ahead)
                    if begin < end:
                        out[0].append(b)
                        out[1].append(begin)
                        out[2].append(text[(begin - first) * width : (end - first) * width])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["block", "begin", "piece"])

    def join(rows: pa.Table) -> pa.Table:
        b = rows.column("block")[0].as_py()
        begins, pieces = rows.column("begin").to_pylist(), rows.column("piece").to_pylist()
        n = max(x - b * block + len(p) // width for x, p in zip(begins, pieces))
        text = bytearray((min(n, block) + ahead) * width)
        for x, p in zip(begins, pieces):
            at = (x - b * block) * width
            text[at : at + len(p)] = p
        return pa.table({"block": [b], "n": pa.array([min(n, block)], pa.int64()), "text": pa.array([bytes(text)], pa.binary())})

    pieces = stream(docs, fmt).select("first", "toks").mapInArrow(cut, "block bigint, begin bigint, piece binary")
    table = materialize(pieces.groupBy("block").applyInArrow(join, "block bigint, n bigint, text binary"))
    return Blocks(table, width, table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], token_bits(top, width), top, head)


def document_blocks(docs: DataFrame, fmt: TokenFormat, head: int = HEAD) -> Blocks:
    """Blocks for what lies inside documents: the documents of a batch one after another, wherever
    they are, so that nothing is shuffled. Only the last document of all has no separator behind it.
    Behind the blocks of a batch one number stays free. The head is made to fill whole words."""
    width, block, ahead = token_bytes(top := _top(docs)), BLOCK, AHEAD
    last = docs.agg(F.max("doc_id")).first()[0]

    def stream(raw: np.ndarray, sizes: np.ndarray, ended: bool) -> tuple[int, bytes]:
        """The suffixes of the documents, a separator before each; and the text."""
        n = len(raw) + len(sizes)
        text = np.full((n + ended, width), 255, dtype=np.uint8)
        text[np.arange(len(raw)) + np.repeat(np.arange(1, len(sizes) + 1), sizes)] = raw
        return n, text.tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("toks"))
            sizes = lists.value_lengths().to_numpy()
            raw = lists.flatten().to_numpy().astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].copy()
            raw[:, -1] += 1
            final = np.asarray([i == last for i in column(batch, "doc_id")], dtype=bool)
            mine = np.repeat(final, sizes)
            for part, some, ended in ((raw[~mine], sizes[~final], True), (raw[mine], sizes[final], False)):
                if not len(some):
                    continue
                n, text = stream(part, some, ended)
                rows = ([], [], [])
                for a in range(0, n + ended, block):
                    rows[0].append(number)
                    rows[1].append(max(0, min(block, n - a)))
                    rows[2].append(text[a * width : (a + block + ahead) * width].ljust((min(n - a, block) + ahead) * width, b"\0"))
                    number += 1
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary())], names=["block", "n", "text"])

    table = materialize(docs.select("doc_id", "toks").mapInArrow(cut, "block bigint, n bigint, text binary"))
    per = 64 // (bits := token_bits(top, width))
    return Blocks(table, width, table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], bits, top, -(-head // per) * per, inside=True)


def _codes(text: bytes, width: int, bits: int) -> np.ndarray:
    """Numbers of the tokens of a text, in the order of their bytes: 0 is the end, the greatest the separator."""
    raw = np.frombuffer(text, dtype=np.uint8).reshape(-1, width)
    last = bits - 8 * (width - 1)
    out = np.zeros(len(raw), dtype=np.uint64)
    for k in range(width - 1):
        out = out << np.uint64(8) | raw[:, k]
    return out << np.uint64(last) | raw[:, -1] & np.uint8((1 << last) - 1)


def _words(codes: np.ndarray, bits: int) -> np.ndarray:
    """From each place on, for which so many are there, as many codes as fit into one number."""
    per = 64 // bits
    n = max(0, len(codes) - per + 1)
    out = codes[:n].copy()
    for k in range(1, per):
        out <<= np.uint64(bits)
        out |= codes[k : k + n]
    return out


def _token(words: list[np.ndarray], d: int, bits: int) -> np.ndarray:
    """The code of number d of each row of words."""
    per = 64 // bits
    return words[d // per] >> np.uint64(bits * (per - 1 - d % per)) & np.uint64((1 << bits) - 1)


def _room(words: list[np.ndarray], n: int, bits: int) -> np.ndarray:
    """The number of leading tokens of each row before a separator or the end of the stream."""
    inside = np.ones(len(words[0]), dtype=bool)
    room = np.zeros(len(inside), dtype=np.int16)
    for d in range(n):
        token = _token(words, d, bits)
        inside &= token - np.uint64(1) < np.uint64((1 << bits) - 2)
        room += inside
    return room


def _order(words: np.ndarray) -> np.ndarray:
    """The order of rows by their words; only rows that agree in the first are compared in the others."""
    by = np.argsort(words[:, 0], kind="stable")
    lead = words[by, 0]
    first = np.ones(len(by) + 1, dtype=bool)
    first[1:-1] = lead[1:] != lead[:-1]
    tied = np.flatnonzero(~(first[:-1] & first[1:]))
    if len(tied) and words.shape[1] > 1:
        rows = by[tied]
        by[tied] = rows[np.lexsort((*words[rows, 1:].T[::-1], np.cumsum(first[:-1])[tied]))]
    return by


def _sorted(words: list[np.ndarray], n: int, bits: int, groups: np.ndarray | None = None, least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by their n tokens, within groups, which are ascending numbers, and of each row
    in it the tokens that it has in common with the one before it, if that is of its group. Each step
    takes the tokens that fit into a number beside group and row, and goes on with what is tied; rows
    that fewer than `least` agree in aren't told apart any further."""
    order = np.arange(len(words[0]))
    same = np.zeros(len(order), dtype=np.int16)
    slots, group, d = order.copy(), np.zeros(len(order), dtype=np.uint64) if groups is None else groups.astype(np.uint64), 0
    while d < n and len(slots):
        row_bits, group_bits = int(len(slots) - 1).bit_length(), int(group[-1]).bit_length()
        c = max(1, min(n - d, (64 - row_bits - group_bits) // bits))
        rows = order[slots]
        mine = [w[rows] if d // (64 // bits) <= k <= (d + c - 1) // (64 // bits) else w for k, w in enumerate(words)]
        value = _token(mine, d, bits)
        for k in range(d + 1, d + c):
            value = value << np.uint64(bits) | _token(mine, k, bits)
        if row_bits + group_bits + c * bits <= 64:
            keys = (group << np.uint64(c * bits) | value) << np.uint64(row_bits) | np.arange(len(slots), dtype=np.uint64)
            keys.sort()
            by, value = (keys & np.uint64((1 << row_bits) - 1)).astype(np.int64), keys >> np.uint64(row_bits) & np.uint64((1 << c * bits) - 1)
        else:
            by = _order(np.column_stack([group, value]))
            value = value[by]
        order[slots] = rows[by]
        alike = group[1:] == group[:-1]
        differ = value[1:] ^ value[:-1]
        common = np.full(len(differ), d, dtype=np.int16)
        for k in range(1, c + 1):
            common += differ < np.uint64(1 << bits * (c - k))
        same[slots[1:]] = np.where(alike, common, same[slots[1:]])
        starts = np.flatnonzero(np.concatenate([[True], ~alike | (differ != 0)]))
        sizes = np.diff(np.append(starts, len(slots)))
        tied = sizes >= max(2, least)
        slots, group, d = slots[np.repeat(tied, sizes)], np.repeat(np.arange(np.count_nonzero(tied), dtype=np.uint64), sizes[tied]), d + c
    return order, same


RANGE = "part bigint, n bigint, pos binary, same binary, room binary, first binary, last binary, tied bigint"


def ranges(text: Blocks) -> DataFrame:
    """The suffixes sorted by their first tokens: for each range, numbered in the order, its n
    suffixes' positions, the tokens that each has in common with the one before it in the range
    (at most head), the tokens before the document's end (as much), and its first and last tokens,
    as numbers of eight bytes. Suffixes of the same first tokens are in the same range; tied of them
    have none of their own."""
    spark, width, bits, head, block, inside = text.table.sparkSession, text.width, text.bits, text.head, BLOCK, text.inside
    per = 64 // bits
    many = -(-head // per)
    spare = np.uint64(bits * (many * per - head))
    kind = f"S{8 * many}"
    wanted = -(-text.ranks // text.range_rows)
    cuts = np.empty(0, dtype=kind)

    def heads(data: bytes) -> np.ndarray:
        return _words(np.append(_codes(data, width, bits), np.zeros(many * per, dtype=np.uint64)), bits)

    def of(leads: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        out = [leads[at + k * per] for k in range(many)]
        out[-1] = out[-1] >> spare << spare
        return out

    def keyed(words: list[np.ndarray]) -> np.ndarray:
        return np.column_stack(words).astype(">u8").view(kind).ravel()

    if wanted > 1:
        every = max(1, text.ranks // (wanted * SAMPLES))

        def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b, n, data in zip(column(batch, "block"), column(batch, "n"), column(batch, "text")):
                    some = keyed(of(heads(data), np.arange(b % every, n, every)))
                    yield pa.RecordBatch.from_arrays([pa.array([some.tobytes()], pa.binary())], names=["keys"])

        keys = np.frombuffer(b"".join(r.keys for r in text.table.mapInArrow(sample, "keys binary").collect()), dtype=kind)
        keys = np.sort(keys)
        cuts = np.unique(keys[np.arange(1, wanted) * len(keys) // wanted])
    shared = spark.sparkContext.broadcast(cuts)
    parts = len(cuts) + 1

    def send(low: int, high: int):
        """Suffixes of the ranges from low on and below high, those of many blocks in one row."""

        def split(base: int, at: list[np.ndarray], words: list[list[np.ndarray]], marks: np.ndarray, begins: np.ndarray) -> pa.RecordBatch:
            at, words = np.concatenate(at), [np.concatenate(w) for w in zip(*words)]
            part = np.searchsorted(begins, words[0], side="right")
            # which side of an end of a range a row is on is open where it begins as the end does
            if len(begins) and len(open_ := np.flatnonzero(begins[np.maximum(part, 1) - 1] == words[0])):
                part[open_] = np.searchsorted(marks, keyed([w[open_] for w in words]), side="right")
            part += max(0, low - 1)
            mine = np.flatnonzero((part >= low) & (part < high))
            by = mine[np.argsort((part[mine] - low).astype(np.uint16 if high - low < 1 << 16 else np.int64), kind="stable")]
            bounds = np.searchsorted(part[by], np.arange(low, high + 1)).tolist()
            at, words = at[by], [w[by] for w in words]
            rows = [(p, base, at[x:y].tobytes(), b"".join(w[x:y].tobytes() for w in words)) for p, x, y in zip(range(low, high), bounds, bounds[1:]) if x < y]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "base", "at", "words"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _keep_memory()
            marks = shared.value[max(0, low - 1) : high]
            begins = np.array([int.from_bytes(m.ljust(8 * many, b"\0")[:8], "big") for m in marks.tolist()], dtype=np.uint64)
            least = begins[0] if low else np.uint64(0)
            most = begins[-1] if high < parts else np.uint64((1 << 64) - 1)
            base, at, words = 0, [], []
            for batch in batches:
                for b, n, data in zip(column(batch, "block"), column(batch, "n"), column(batch, "text")):
                    if at and (sum(map(len, at)) >= SENT_ROWS or not 0 <= (b - base) * block < (1 << 32) - block):
                        yield split(base, at, words, marks, begins)
                        at, words = [], []
                    if not at:
                        base = b
                    leads = heads(data)
                    some = np.flatnonzero((leads[:n] >= least) & (leads[:n] <= most))
                    at.append((some + (b - base) * block).astype(np.uint32))
                    words.append(of(leads, some))
            if at:
                yield split(base, at, words, marks, begins)

        return run

    def order(rows: pa.Table) -> pa.Table:
        _keep_memory()
        got = [(base, np.frombuffer(at, "<u4"), np.frombuffer(words, "<u8").reshape(many, -1)) for base, at, words in zip(*(rows.column(c).to_pylist() for c in ("base", "at", "words")))]
        pos = np.concatenate([at.astype(np.int64) + base * block for base, at, _ in got])
        words = [np.concatenate([w[k] for *_, w in got]) for k in range(many)]
        by, same = _sorted(words, head, bits)
        room = _room(words, head, bits)[by]
        ends = [np.array([_token([w[by[[e]]] for w in words], d, bits)[0] for d in range(head)]).astype(">u8").tobytes() for e in (0, -1)]
        pos, agree = pos[by], np.minimum(same, room) if inside else same
        if inside:
            pos = pos[members(np.zeros(len(by), dtype=np.int64), agree, head, 2)[0]]
        made = {"part": rows.column("part")[:1], "n": [len(by)], "pos": [packed(pos)], "same": [packed(same)], "room": [packed(room)], "first": [ends[0]], "last": [ends[1]], "tied": [int((agree >= head).sum())]}
        return pa.table({k: v.cast(pa.int64()) if k == "part" else pa.array(v, pa.int64() if isinstance(v[0], int) else pa.binary()) for k, v in made.items()})

    each = max(1, text.pass_rows // text.range_rows, -(-parts // PASSES))
    out = None
    for low in range(0, parts, each):
        sent = text.table.mapInArrow(send(low, min(parts, low + each)), "part bigint, base bigint, at binary, words binary")
        done = materialize(sent.groupBy("part").applyInArrow(order, RANGE))
        out = done if out is None else out.unionAll(done)
    return out


def members(lo: np.ndarray, same: np.ndarray, full: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order, (which, group): those that agree in `full` tokens with a neighbour, in
    groups of `least` or more, and the index of each one's group's first row. lo: rows of other
    groups before are told apart by another number."""
    starts = np.ones(len(same), dtype=bool)
    starts[1:] = (same[1:] < full) | (lo[1:] != lo[:-1])
    first = np.flatnonzero(starts)
    sizes = np.diff(np.append(first, len(same)))
    group = np.repeat(first, sizes)
    which = np.flatnonzero(np.repeat(sizes >= max(2, least), sizes))
    return which, group[which]


ROUND = "part bigint, lo binary, at binary, pos binary, same binary, room binary, tied bigint"


def further(text: Blocks, rows: DataFrame, depth: int, before: int, step: int, least: int = 2) -> DataFrame:
    """Rows of ranges or of an earlier round, whose `before` tokens end at depth: those that agree
    in all of them are sorted by the next `step` tokens. In each range, in order: the index of the
    first of the old group and its own, the position, the tokens in common with the one before it,
    if it is of the group, and those before the document's end. Groups of fewer than `least` are left
    out, and inside documents those that hold a separator."""
    width, bits, block, inside = text.width, text.bits, BLOCK, text.inside
    per = 64 // bits
    many = -(-step // per)
    ranged = "lo" not in rows.columns
    # blocks that are held at a time: what is fetched from them stays within a bound
    held_blocks = max(1, min(8, 128 // step, text.ranks // (48 * block)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: tuple[list, list, list] = ([], [], [])
            for i, part in enumerate(column(batch, "part")):
                get = lambda c, k: unpacked(batch.column(batch.schema.get_field_index(c))[i].as_py(), k)  # noqa: E731, B023
                pos, same = get("pos", "<i8"), get("same", "<i2")
                if inside:
                    same = np.minimum(same, get("room", "<i2"))
                at, lo = (np.arange(len(same)), np.zeros(len(same), dtype=np.int64)) if ranged else (get("at", "<i8"), get("lo", "<i8"))
                which, group = members(lo, same, before, least)
                if inside:
                    pos = pos[np.searchsorted(members(lo, same, before, 2)[0], which)]
                else:
                    pos = pos[which]
                for x, y in zip(got, (np.full(len(which), part), at[group], pos)):
                    x.append(y)
            part, start, pos = (np.concatenate([np.empty(0, dtype=np.int64), *x]) for x in got)
            to = (pos + depth) // block // held_blocks
            by = np.argsort(to, kind="stable")
            part, start, pos, to = part[by], start[by], pos[by], to[by]
            cut = np.append(np.flatnonzero(np.diff(to, prepend=-1)), len(to)).tolist()
            rows = [(int(to[x]), *(packed(c[x:y]) for c in (part, start)), pos[x:y].tobytes()) for x, y in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k else pa.int64()) for k in range(4)], names=["held", "part", "lo", "pos"])

    def fetch(asked: pa.Table, held: pa.Table) -> pa.Table:
        _keep_memory()
        get = lambda c, k: np.concatenate([np.empty(0, dtype=k), *(unpacked(x, k) for x in asked.column(c).to_pylist())])
        part, lo = get("part", "<i8"), get("lo", "<i8")
        pos = np.frombuffer(b"".join(asked.column("pos").to_pylist()), "<i8")
        blocks, texts = zip(*sorted(zip(held.column("block").to_pylist(), held.column("text").to_pylist()))) if held.num_rows else ((-1,), (b"",))
        behind = np.zeros(step + 2 * per, dtype=np.uint64)  # the end
        codes = [np.append(_codes(t, width, bits), behind) for t in texts]
        begins, sizes = np.cumsum([0, *map(len, codes)]), np.array([len(c) - len(behind) for c in codes])
        words = _words(np.concatenate(codes), bits)
        by = np.argsort(part, kind="stable")
        part, lo, pos = part[by], lo[by], pos[by]
        to = (pos + depth) // block
        i = np.minimum(np.searchsorted(blocks, to), len(blocks) - 1)
        at = begins[i] + np.where(np.array(blocks)[i] == to, np.minimum(pos + depth - to * block, sizes[i]), sizes[i])
        cut = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part)).tolist()
        out = [(int(part[x]), packed(lo[x:y]), pos[x:y].tobytes(), b"".join(words[at[x:y] + k * per].tobytes() for k in range(many))) for x, y in zip(cut, cut[1:])]
        return pa.table([pa.array([r[k] for r in out], pa.binary() if k else pa.int64()) for k in range(4)], names=["part", "lo", "pos", "toks"])

    def order(rows: pa.Table) -> pa.Table:
        lo = np.concatenate([unpacked(x, "<i8") for x in rows.column("lo").to_pylist()])
        by = np.argsort(lo, kind="stable")
        lo, pos = lo[by], np.frombuffer(b"".join(rows.column("pos").to_pylist()), "<i8")[by]
        toks = [np.frombuffer(x, "<u8").reshape(many, -1) for x in rows.column("toks").to_pylist()]
        words = [np.concatenate([x[k] for x in toks])[by] for k in range(many)]
        first = np.ones(len(lo), dtype=bool)
        first[1:] = lo[1:] != lo[:-1]
        starts = np.flatnonzero(first)
        at = lo + np.arange(len(lo)) - np.repeat(starts, np.diff(np.append(starts, len(lo))))
        by, same = _sorted(words, step, bits, np.cumsum(first) - 1, least)
        pos, room = pos[by], _room(words, step, bits)[by]
        agree = np.minimum(same, room) if inside else same
        if inside:
            pos = pos[members(lo, agree, step, 2)[0]]
        made = [rows.column("part")[:1].cast(pa.int64()), *(pa.array([packed(x)], pa.binary()) for x in (lo, at, pos, same, room)), pa.array([int((agree >= step).sum())], pa.int64())]
        return pa.table(made, names=["part", "lo", "at", "pos", "same", "room", "tied"])

    asked = rows.where("tied > 0").mapInArrow(ask, "held bigint, part binary, lo binary, pos binary")
    held = text.table.withColumn("held", F.floor(F.col("block") / held_blocks))
    got = asked.groupBy("held").cogroup(held.groupBy("held")).applyInArrow(fetch, "part bigint, lo binary, pos binary, toks binary")
    return materialize(got.groupBy("part").applyInArrow(order, ROUND))
