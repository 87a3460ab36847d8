"""Encoding texts with a public byte-level BPE tokenizer through a tokenization automaton.

The automaton's states are tokens: an arc x -> y says that y may follow x in the output of the
merges. It starts as one state with an arc for every byte. Each merge (u, v) -> w adds one
gadget: a state for w that leaves as v's state leaves, an arc for w into every state that u's
arc came from, and it removes the arc from u to v. The gadgets are added one after another, in the
order of the merges, to the table of states, where a state is found by the bytes of its arcs' label
from the last one back; a gadget whose arc from u to v is closed by then makes no state, as its token
never comes out. A sequence of tokens is an encoding if each arc between two neighbours is open, and
every string of bytes has exactly one. So there is one last token for each beginning of a word, and
encoding goes through a word once, from state to state by the table, without a choice and without
going back. Decoding is writing the arcs' labels one after another.

As every gadget copies one row and one column of the arcs and clears one cell, an arc's presence
follows from the gadgets of its two ends; the matrix of all pairs of tokens, which would have
billions of cells, isn't written out, but an arc that was once asked for is kept.
"""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public tokenizers' files lie; every function below takes another path.
TOKENIZERS = os.environ.get("SPANLOOM_TOKENIZERS", "/opt/tokenizers")
#: The pattern by which this tokenizer family cuts text before the merges (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words whose ids a worker keeps; the table is emptied when full, so this bounds memory only.
KEPT_WORDS = 200_000


def byte_letters() -> dict[str, int]:
    """The letters that the vocabulary file writes for bytes: printable bytes stand for
    themselves, the others for the letters from 256 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TokenAutomaton:
    """See the module's text. vocabulary: bytes -> id; merges: pairs of bytes in order."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.label = {i: b for b, i in vocabulary.items()}
        self.born: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.gadget: dict[tuple[int, int], int] = {}
        self.arcs: dict[tuple[int, int], bool] = {}
        #: next node by (node, byte), from the end of a label back; node 0 is the root
        self.back: dict[int, int] = {}
        self.state: list[int] = [-1]  # the token whose label leads to a node, or -1
        for b, i in vocabulary.items():
            if len(b) == 1:
                self._add_state(b, i)
        made = {i for b, i in vocabulary.items() if len(b) == 1}
        for time, (u, v) in enumerate(merges):
            a, b, w = vocabulary[u], vocabulary[v], vocabulary[u + v]
            if w not in self.born:
                self.born[w], self.parts[w] = time, (a, b)
                if a in made and b in made and self._open(a, b, time):
                    made.add(w)
                    self._add_state(u + v, w)
            self.gadget.setdefault((a, b), time)

    def _add_state(self, label: bytes, token: int) -> None:
        node = 0
        for byte in reversed(label):
            at = node << 8 | byte
            node = self.back.get(at, 0)
            if not node:
                node = self.back[at] = len(self.state)
                self.state.append(-1)
        self.state[node] = token

    def _open(self, x: int, y: int, horizon: float) -> bool:
        """Whether no gadget added before horizon removed the arc from x to y."""
        born, parts, gadget = self.born, self.parts, self.gadget
        while True:
            if gadget.get((x, y), horizon) < horizon:
                return False
            at_x, at_y = born.get(x, -1), born.get(y, -1)
            if at_x < 0 and at_y < 0:
                return True
            if at_x > at_y:  # x's state was copied from its right part when x was born
                horizon, x = at_x, parts[x][1]
            else:  # y's arc was copied from its left part's, whose gadget had run by then
                horizon, y = at_y + 1, parts[y][0]

    def arc(self, x: int, y: int) -> bool:
        found = self.arcs.get((x, y))
        if found is None:
            if len(self.arcs) > 4 * KEPT_WORDS:
                self.arcs.clear()
            found = self.arcs[x, y] = self._open(x, y, float("inf"))
        return found

    def encode(self, word: bytes) -> list[int]:
        """The one path whose labels spell word."""
        back, state, arcs, label = self.back, self.state, self.arcs, self.label
        last = [-1] * (len(word) + 1)  # the last token of each beginning of the word
        for end in range(1, len(word) + 1):
            node, at = 0, end
            while at:
                node = back.get(node << 8 | word[at - 1])
                if not node:
                    break
                at -= 1
                token = state[node]
                if token >= 0:
                    before = last[at]
                    if not at or (before >= 0 and (arcs[before, token] if (before, token) in arcs else self.arc(before, token))):
                        last[end] = token
                        break
            if last[end] < 0:
                raise ValueError("the vocabulary lacks a byte")
        path: list[int] = []
        at = len(word)
        while at:
            path.append(last[at])
            at -= len(label[last[at]])
        return path[::-1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.label.__getitem__, ids))


def load_automaton(name: str = "byte_bpe_50k", path: str = TOKENIZERS) -> TokenAutomaton:
    with open(os.path.join(path, f"{name}.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = byte_letters()
    raw = lambda s: bytes(letters[c] for c in s)
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    known = {c for c in letters}
    vocabulary = {raw(s): i for s, i in model["vocab"].items() if set(s) <= known}
    return TokenAutomaton(vocabulary, [(raw(a), raw(b)) for a, b in merges])


class _Words(dict):
    """Ids of what stands between two single spaces, with the space before it. Such a stretch
    is cut and merged alike in every text."""

    def __init__(self, automaton: TokenAutomaton):
        self.automaton = automaton
        self.cut = regex.compile(SPLIT).findall
        self.words: dict[str, list[int]] = {}

    def tokens(self, text: str) -> tuple[int, ...]:
        out: list[int] = []
        words = self.words
        for w in self.cut(text):
            ids = words.get(w)
            if ids is None:
                if len(words) > KEPT_WORDS:
                    words.clear()
                ids = self.automaton.encode(w.encode("utf-8", "surrogatepass"))
                if len(w) < 64:
                    words[w] = ids
            out += ids
        return tuple(out)

    def __missing__(self, stretch: str):
        if not stretch or stretch[0].isspace() or stretch[-1].isspace():
            raise KeyError(stretch)
        ids = self.tokens(" " + stretch)
        if len(stretch) < 64:
            if len(self) > KEPT_WORDS:
                self.clear()
            self[stretch] = ids
        return ids


class Encoder:
    """Encodes whole texts; one for each worker process."""

    def __init__(self, automaton: TokenAutomaton):
        self.words = _Words(automaton)
        self.blank = regex.compile(r"(?<=\S) (?=\S)")

    def parts(self, text: str | None) -> list[tuple[int, ...]]:
        """The ids of a text in parts; none for an empty or null text."""
        if not text:
            return []
        first, *rest = text.split(" ")
        known = self.words.__getitem__
        if first and not first[-1].isspace():
            try:
                return [self.words.tokens(first), *map(known, rest)]
            except KeyError:
                pass
        first, *rest = self.blank.split(text)
        return [self.words.tokens(first), *(self._stretch(r) for r in rest)]

    def _stretch(self, s: str) -> tuple[int, ...]:
        try:
            return self.words[s]
        except KeyError:
            return self.words.tokens(" " + s)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(name: str, path: str) -> Encoder:
    if (name, path) not in _encoders:
        _encoders[name, path] = Encoder(load_automaton(name, path))
    return _encoders[name, path]


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", path: str = TOKENIZERS) -> DataFrame:
    """(id_col, ids array<int>): the ids of each text, without special tokens; the strings of
    special tokens in a text are ordinary text. One row for each row of df, in which null and
    empty texts give an empty list; null ids stay. Other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, path)
        for batch in batches:
            ends, flat = np.zeros(batch.num_rows + 1, dtype=np.int32), []
            for i, text in enumerate(batch.column(1).to_pylist(), 1):
                parts = enc.parts(text)
                flat += parts
                ends[i] = ends[i - 1] + sum(map(len, parts))
            ids = np.fromiter(itertools.chain.from_iterable(flat), dtype=np.int32, count=int(ends[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", path: str = TOKENIZERS) -> DataFrame:
    """(id_col, n_tokens bigint): the size of each text in tokens; 0 for null and empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, path)
        for batch in batches:
            sizes = [sum(map(len, enc.parts(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["id", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens bigint").withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str = "byte_bpe_50k", path: str = TOKENIZERS) -> DataFrame:
    """(id_col, text): the labels of the ids one after another; bytes that are no UTF-8 become
    U+FFFD, and a null list gives a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = encoder(tokenizer, path).words.automaton
        for batch in batches:
            texts = [None if x is None else automaton.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
