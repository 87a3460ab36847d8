"""Leaks, versions, cross-split pairs and shared spans against brute force."""

from __future__ import annotations

import random
import re

import pytest

from spanloom.llm import leaks, overlap, repeats, versions

WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]


def sentence(draw, n):
    return [draw.choice(WORDS) for _ in range(n)]


def edited(draw, words, edits):
    out = list(words)
    for _ in range(edits):
        at = draw.randrange(len(out))
        kind = draw.random()
        if kind < 0.4:
            out[at] = draw.choice(WORDS)
        elif kind < 0.6:
            out.insert(at, draw.choice(WORDS))
        elif kind < 0.8 and len(out) > 5:
            del out[at]
        else:
            out = out[at:] + out[:at]
    return out


@pytest.fixture(scope="module")
def rows():
    """Texts with versions of each other, a boilerplate that many hold, copies, and odd rows."""
    draw = random.Random(11)
    boiler = " ".join(sentence(draw, 18))
    texts = []
    for _ in range(50):
        base = sentence(draw, draw.choice([19, 20, 22, 30, 60, 150, 400]))
        texts.append(" ".join(base))
        for _ in range(draw.choice([0, 0, 1, 2, 3])):
            texts.append(" ".join(edited(draw, base, draw.randint(0, max(1, len(base) // 14)))))
    texts = [f"{t}. {boiler.title()}!" if draw.random() < 0.5 else t for t in texts]
    texts += [texts[3], texts[3].upper().replace(" ", ", "), texts[3], boiler, "", None, " \n", "🙂 only", "a b c", "la " * 300, "la " * 260]
    splits = ["train", "Train ", "test", " VALIDATION", None, "train", "other"]
    return [(5 * i + 1, t, splits[draw.randrange(len(splits))], 0, "k") for i, t in enumerate(texts)] + [(None, texts[3], "train", 0, "k")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, split string, n int, key string").cache()


def words_of(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


@pytest.fixture(scope="module")
def similar(rows):
    sets = {}
    for i, t, *_ in rows:
        w = words_of(t)
        if i is not None and len(w) >= 20:
            sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}


def test_version_groups(docs, similar):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for (a, b), s in similar.items():
        if s >= 0.6:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = versions.version_groups(docs)
    assert sorted((r.group_id, r.doc_id) for r in got.collect()) == sorted((find(x), x) for x in list(parent))
    assert versions.version_groups(docs.unionAll(docs.limit(9))).count() == got.count()
    assert versions.version_groups(docs.limit(0)).count() == 0


def test_cross_split_pairs(docs, rows, similar):
    kind = {i: (s or "").strip().lower() for i, _, s, *_ in rows if i is not None}
    held = ["test", "validation"]
    want = sorted(p for p, s in similar.items() if s >= 0.6 and ((kind[p[0]] == "train" and kind[p[1]] in held) or (kind[p[1]] == "train" and kind[p[0]] in held)))
    got = overlap.cross_split_pairs(docs, held).collect()
    assert want and sorted((r.doc_a, r.doc_b) for r in got) == want
    assert all(abs(r.similarity - similar[r.doc_a, r.doc_b]) < 1e-9 and 0 <= r.cover_a <= 1 for r in got)
    assert overlap.cross_split_pairs(docs.limit(0), held).count() == 0


def stretches(rows):
    pieces = {i: re.findall(r"[^ \t\n\r]+", t or "") for i, t, *_ in rows if i is not None}
    seen = {}
    for i, p in pieces.items():
        for k in range(len(p) - 39):
            seen.setdefault(tuple(p[k : k + 40]), set()).add(i)
    out = []
    for i, p in pieces.items():
        covered = set()
        for k in range(len(p) - 39):
            if len(seen[tuple(p[k : k + 40])]) > 1:
                covered.update(range(k, k + 40))
        at = 0
        while at < len(p):
            end = at
            while end in covered:
                end += 1
            if end > at:
                out.append((i, at, end - at))
            at = max(end, at + 1)
    return sorted(out)


def test_shared_stretches(spark, docs, rows):
    got = repeats.shared_stretches(docs)
    assert sorted(map(tuple, got.collect())) == stretches(rows)
    assert repeats.shared_stretches(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_spans_of_just_forty_pieces_are_found(spark, seed):
    """Spans of 38 to 60 pieces planted at random places, over a small alphabet with long runs."""
    draw = random.Random(seed)
    some = ["x", "y", "zz", "-", "w1", "w2"]
    texts = [[draw.choice(WORDS if draw.random() < 0.7 else some) for _ in range(draw.randint(30, 200))] for _ in range(40)]
    for _ in range(60):
        a, b = draw.sample(range(40), 2)
        n = draw.randint(38, 60)
        if len(texts[a]) > n:
            k = draw.randrange(len(texts[a]) - n)
            at = draw.randrange(len(texts[b]))
            span = texts[a][k : k + n]
            texts[b][at:at] = span if draw.random() < 0.7 else ["-"] * draw.randint(30, 50) + span
    rows = [(i, draw.choice([" ", "\n", " \t"]).join(t)) for i, t in enumerate(texts)]
    got = repeats.shared_stretches(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect())) == stretches(rows)


ITEMS = "item_id bigint, text string, doc_id bigint"


def test_leaks(spark, docs, rows):
    draw = random.Random(3)
    texts = [words_of(t) for _, t, *_ in rows if t and len(words_of(t)) > 40]
    items = []
    for i in range(40):
        w = draw.choice(texts)
        n = draw.choice([1, 2, 3, 5, 7, 9, 11, 12, 13, 20, 38])
        at = draw.randrange(len(w) - n)
        own = w[at : at + n] if i % 4 else [*sentence(draw, 6), *w[at : at + n], *sentence(draw, 6)]
        items.append((i, " ".join(own).title() + ".", 0))
    items += [(90, None, 0), (91, "", 0), (92, "--", 0), (None, "la", 0), (93, items[5][1], 0)]
    want = set()
    runs = {}
    for i, t, _ in items:
        w = words_of(t)
        if i is not None and w:
            k = min(12, len(w))
            runs[i] = (k, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)})
    for d, t, *_ in rows:
        w = words_of(t)
        for i, (k, own) in runs.items():
            if any(tuple(w[j : j + k]) in own for j in range(len(w) - k + 1)):
                want.add((i, d))
    table = spark.createDataFrame(items, ITEMS)
    for block in (8_000_000, 300):
        got = leaks.find_leaks(docs, table, block_chars=block)
        found = got.collect()
        assert {(r.item_id, r.doc_id) for r in found} == want
    by_item, by_doc = {i: words_of(t) for i, t, _ in items}, {}
    for d, t, *_ in rows:
        by_doc.setdefault(d, words_of(t))
    for r in found:
        a, b = by_item[r.item_id], by_doc[r.doc_id]
        assert a[r.item_word : r.item_word + r.n_words] == b[r.doc_word : r.doc_word + r.n_words]
        after = (r.item_word + r.n_words, r.doc_word + r.n_words)
        assert after[0] == len(a) or after[1] == len(b) or a[after[0]] != b[after[1]]
    left = leaks.without_leaks(docs, got)
    assert {r.doc_id for r in left.collect()} == {r[0] for r in rows} - {d for _, d in want if d is not None}
    assert leaks.find_leaks(docs.limit(0), table).count() == 0
    assert leaks.find_leaks(docs, table.limit(0)).count() == 0


def test_leaks_of_repeated_words(spark):
    items = spark.createDataFrame([(1, "la " * 300), (2, "x y " * 50), (3, "a " * 30 + "b")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "go " + "la " * 2000 + "x y " * 9), (2, "a " * 20 + "b"), (3, "la la")], "doc_id bigint, text string")
    found = {tuple(r) for r in leaks.find_leaks(docs, items).collect()}
    whole = {r for r in found if r[0] == 1 and r[2] == 0}
    assert {r[:2] for r in found} == {(1, 1), (2, 1), (3, 2)}
    assert len(whole) == 1989 and max(r[4] for r in whole) == 300
    assert (3, 2, 10, 0, 21) in found and (2, 1, 0, 2001, 18) in found
