"""Column expressions on tokens, keys and sizes."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.config import Shards, TokenFormat


def token_key(token: Column, fmt: TokenFormat) -> Column:
    """The id's bytes, least first, as upper-case hex: it sorts as the bytes do."""
    parts = [F.lpad(F.hex(F.shiftrightunsigned(token.cast("bigint"), 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(fmt.token_bytes)]
    return F.concat(*parts)


def encode(tokens: Column, fmt: TokenFormat) -> Column:
    return F.array_join(F.transform(tokens, lambda t: token_key(t, fmt)), "")


def depth_of(key: Column, fmt: TokenFormat) -> Column:
    return F.floor(F.length(key) / fmt.width).cast("int")


def prefix(key: Column, depth: int | Column, fmt: TokenFormat) -> Column:
    n = F.lit(depth) if isinstance(depth, int) else depth
    return F.substring(key, F.lit(1), n * F.lit(fmt.width))


def entry_bytes(depth: Column, fmt: TokenFormat) -> Column:
    return F.when(depth == 0, F.lit(0)).otherwise(depth * fmt.token_bytes + fmt.bound_bytes).cast("bigint")


def pointer_size(size: Column) -> Column:
    """Bytes of a pointer into size bytes: the least n >= 1 with 256**n >= size."""
    at_least = F.lit(1)
    for n in range(1, 8):
        at_least = F.when(size.cast("decimal(20,0)") > F.lit(256**n).cast("decimal(20,0)"), F.lit(n + 1)).otherwise(at_least)
    return at_least.cast("int")


def pages_touched(start: Column, n_bytes: Column, fmt: TokenFormat) -> Column:
    """Pages that a read of n_bytes from start touches; 0 for an empty read."""
    page = fmt.page_bytes
    return F.when(n_bytes <= 0, F.lit(0)).otherwise(F.floor((start + n_bytes - 1) / page) - F.floor(start / page) + 1).cast("bigint")


def depth_name(depth: Column) -> Column:
    names = F.when(depth == 1, "unigram").when(depth == 2, "bigram").when(depth == 3, "trigram")
    return names.otherwise(F.concat(depth.cast("string"), F.lit("-gram")))


def greedy_label(floor: Column) -> Column:
    return F.when(floor == 0, F.lit("greedy")).otherwise(F.concat(F.lit("greedy, all up to "), depth_name(floor)))


def speedup(baseline: Column, steps: Column) -> Column:
    return baseline / F.greatest(steps, F.lit(1e-9))


def shard_file(split: Column, index: Column, shards: Shards) -> Column:
    """Shards.file_name as an expression; null for a split of unknown total."""
    parts, values = "", []
    total = F.lit(None).cast("int")
    for name, n in shards.totals.items():
        total = F.when(split == name, F.lit(n)).otherwise(total)
    columns = {"split": split, "index": index.cast("int"), "total": total}
    for text, name, kind, _ in Formatter().parse(shards.pattern):
        parts += text.replace("%", "%%")
        if name is not None:
            parts += f"%{kind or ('s' if name == 'split' else 'd')}"
            values.append(columns[name])
    return F.when(total.isNotNull(), F.format_string(parts, *values))
