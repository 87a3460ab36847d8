"""Typed settings, read from one JSON file. A missing or unknown setting is an error."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from hashlib import sha256


@dataclass(frozen=True)
class TokenFormat:
    """How a token id is written as a sortable key: the id's bytes in little-endian order, as
    upper-case hex. The separator is the greatest id of its width, so it sorts last."""

    token_bytes: int = 4
    bound_bytes: int = 10
    page_bytes: int = 4096

    @property
    def separator(self) -> int:
        return (1 << 8 * self.token_bytes) - 1

    @property
    def width(self) -> int:
        """Hex digits of a token."""
        return 2 * self.token_bytes

    @property
    def separator_key(self) -> str:
        return "F" * self.width

    def token_key(self, token: int) -> str:
        if not 0 <= token <= self.separator:
            raise ValueError(f"{token} is no token of {self.token_bytes} bytes")
        return token.to_bytes(self.token_bytes, "little").hex().upper()

    def encode(self, tokens: list[int]) -> str:
        return "".join(map(self.token_key, tokens))

    def entry_bytes(self, depth: int) -> int:
        """What a cache entry costs: its tokens and two bounds; the root is free."""
        return 0 if depth == 0 else self.token_bytes * depth + self.bound_bytes


@dataclass(frozen=True)
class Shards:
    """Names of shards: a format of split, index and total, the number of shards of the split."""

    pattern: str = "en/web-{split}.{index:05d}-of-{total:05d}.json.gz"
    totals: dict[str, int] = field(default_factory=dict)

    def total(self, split: str) -> int:
        if split not in self.totals:
            raise ValueError(f"the number of shards of {split} isn't set")
        return self.totals[split]

    def file_name(self, split: str, index: int) -> str:
        if not 0 <= index < self.total(split):
            raise ValueError(f"{split} has {self.total(split)} shards, not one of number {index}")
        return self.pattern.format(split=split, index=index, total=self.total(split))


@dataclass(frozen=True)
class Workload:
    lengths: tuple[int, ...] = (1, 2, 3, 4, 5, 6, 8, 10)
    per_length: int = 1000
    seed: int = 0
    latency_length: int = 4
    latency_queries: int = 1000


@dataclass(frozen=True)
class Caches:
    fixed_depths: tuple[int, ...] = (1, 2, 3)
    greedy_floors: tuple[int, ...] = (0, 2)
    #: Levels that are counted over the whole corpus; greedy caches go on from the last one, to any
    #: depth, over what occurs twice.
    whole_levels: int = 4


@dataclass(frozen=True)
class Settings:
    tokens: TokenFormat = TokenFormat()
    shards: Shards = Shards()
    workload: Workload = Workload()
    caches: Caches = Caches()

    def digest(self) -> str:
        """A name of these settings, for the paths of what is built with them."""
        return sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


_SECTIONS = {"tokens": TokenFormat, "shards": Shards, "workload": Workload, "caches": Caches}


def load(path: str) -> Settings:
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    if set(raw) != set(_SECTIONS):
        raise ValueError(f"sections {sorted(set(raw) ^ set(_SECTIONS))} are missing or unknown")
    made = {}
    for name, kind in _SECTIONS.items():
        known = {f.name for f in fields(kind)}
        if set(raw[name]) != known:
            raise ValueError(f"{name}: {sorted(set(raw[name]) ^ known)} are missing or unknown")
        made[name] = kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw[name].items()})
    return Settings(**made)
