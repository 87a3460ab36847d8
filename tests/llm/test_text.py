"""Names of words and pieces, and the tokenizer, against plain definitions and the library."""

from __future__ import annotations

import os
import random
import re

import numpy as np
import pytest

from spanloom.llm import text as T
from spanloom.llm import tokenize

ODD = ["", " ", "\n\r\t", "a", "Ünïcödé ǅ İstanbul ΑΣ", "don't stop—now", "x" * 5000, "日本語テスト 한국어 🙂🙃", "éä zero​width", "a\x0bb\x0cc\x1cd e", "  two  spaces ", "1²½ ٣ Ⅷ _under_score_", "end\r\n"]


def test_plain_words_are_runs_of_letters_and_digits():
    found = [re.findall(r"[^\W_]+", t.lower()) for t in ODD]
    names, bounds = T.plain_words(ODD)
    assert list(np.diff(bounds)) == [len(w) for w in found]
    flat = [w for ws in found for w in ws]
    assert len(set(zip(flat, names.tolist()))) == len(set(flat)) == len(set(names.tolist()))


def test_pieces_are_cut_at_four_characters_only():
    found = [re.findall(r"[^ \t\n\r]+", t) for t in ODD]
    names, bounds = T.pieces(ODD)
    assert list(np.diff(bounds)) == [len(w) for w in found]
    flat = [w for ws in found for w in ws]
    assert len(set(zip(flat, names.tolist()))) == len(set(flat)) == len(set(names.tolist()))


def test_windows_depend_on_their_names_alone():
    a = np.arange(50, dtype=np.uint64) % np.uint64(7)
    w = T.windows(a, 3)
    assert len(w) == 48 and w[0] == w[7] and len(set(w.tolist())) == 7
    assert len(T.windows(a[:2], 3)) == 0


@pytest.fixture(scope="module")
def library():
    if not os.path.exists(f"{tokenize.TOKENIZERS}/byte_bpe_50k.json"):
        pytest.skip("no tokenizer files here")
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(f"{tokenize.TOKENIZERS}/byte_bpe_50k.json")
    lib.encode_special_tokens = True
    return lib


def test_ids_are_the_librarys(spark, library):
    draw = random.Random(0)
    alphabet = list("abcdefghij  ABC'stlé\n\t0123.,-ßяжå語🙂")
    texts = [*ODD, "<|endoftext|> as text", "we'll they're I'd", "aaaaaaaaaaaaaaaa" * 9, *("".join(draw.choice(alphabet) for _ in range(draw.randint(1, 200))) for _ in range(150))]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(900, None, "x", 1), (901, texts[4], "x", 1), (901, texts[4], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, id int")
    got = tokenize.encode_texts(df)
    assert got.columns == ["doc_id", "ids"]
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t, *_ in rows}
    assert sorted((r.doc_id, r.ids) for r in got.collect()) == sorted((i, want[i]) for i, *_ in rows)
    assert {r.doc_id: r.n_tokens for r in tokenize.count_tokens(df).collect()} == {i: len(v) for i, v in want.items()}
    back = {r.doc_id: r.text for r in tokenize.decode_ids(got).collect()}
    assert all(back[i] == (t or "") for i, t, *_ in rows)
    assert tokenize.encode_texts(df.limit(0)).count() == 0


def test_the_automaton_does_what_merging_does():
    """Random merge lists over three letters, against merging pairs by rank, leftmost first."""
    draw = random.Random(4)
    for _ in range(60):
        known, merges = [b"a", b"b", b"c"], []
        for _ in range(draw.randint(1, 14)):
            u, v = draw.choice(known), draw.choice(known)
            if u + v not in known and len(u + v) <= 8:
                merges.append((u, v))
                known.append(u + v)
        machine = tokenize.TokenAutomaton({b: i for i, b in enumerate(known)}, merges)
        rank = {m: i for i, m in enumerate(merges)}
        for _ in range(60):
            word = bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 12)))
            parts = [bytes([c]) for c in word]
            while True:
                best = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
                if best is None:
                    break
                pair, at, out = merges[best[0]], 0, []
                while at < len(parts):
                    if at + 1 < len(parts) and (parts[at], parts[at + 1]) == pair:
                        out.append(parts[at] + parts[at + 1])
                        at += 2
                    else:
                        out.append(parts[at])
                        at += 1
                parts = out
            ids = machine.encode(word)
            assert [machine.label[i] for i in ids] == parts
            assert machine.decode(ids) == word
