"""A session and the small synthetic corpus that most tests share."""

from __future__ import annotations

import random

import pytest

from spanloom.config import TokenFormat
from spanloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def fmt() -> TokenFormat:
    return TokenFormat(token_bytes=2)


@pytest.fixture(scope="session")
def tokens() -> list[list[int]]:
    """40 documents of up to 30 tokens, ids above 255 among them; an empty document, one shorter
    than a window, and two copies."""
    draw = random.Random(0)
    ids = [*range(9), 255, 258, 513, 4096]
    docs = [[draw.choice(ids) for _ in range(draw.randint(3, 30))] for _ in range(36)]
    return [docs[0], [], [7], *docs[1:20], docs[4], *docs[20:], docs[4]]


@pytest.fixture(scope="session")
def docs(spark, tokens):
    return spark.createDataFrame([(10 * i, t) for i, t in enumerate(tokens)], "doc_id bigint, toks array<bigint>").cache()


@pytest.fixture(scope="session")
def suffixes(tokens) -> list[bytes]:
    """All suffixes of the stream, in order: what a suffix array would list."""
    flat = [t for d in tokens for t in (65535, *d)]
    return sorted(b"".join(t.to_bytes(2, "little") for t in flat[i:]) for i in range(len(flat)))


def bytes_of(key: str) -> bytes:
    return bytes.fromhex(key)


def interval(suffixes: list[bytes], query: bytes) -> tuple[int, int]:
    """By definition: the suffixes less than the query, and those that begin with it."""
    lo = sum(s < query for s in suffixes)
    return lo, lo + sum(s.startswith(query) for s in suffixes)
