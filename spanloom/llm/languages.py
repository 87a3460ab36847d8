"""The languages of texts and of their parts, by error-correcting output codes.

Every language has a codeword of BITS bits, chosen so that any two differ in many. For each bit a
binary classifier over the character runs of words tells its two groups of languages apart
(smoothed log odds of the runs in clean labelled samples). The margins of a word's runs add
up, so a word has a margin for each bit, and so has every stretch of words. Decoding weights the
loss of each bit by how reliable its classifier was on the samples, and takes the codeword with the
least loss; what the second best loses more is the confidence, and below AMBIGUOUS it is flagged.

A text is first held in windows: where all windows speak for one language, it is written in that
language. Otherwise the best sequence of languages over its words is found (a change of language
costs CHANGE words' worth of evidence), which cuts it into segments. One of the states is no
language: numbers, names and unknown scripts, whose characters speak for none, are cut off by it
from a stretch beside them, and each stretch is judged by its own words. A segment counts as written
in its language from LONG words on, if its margins are those of a language at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.tables import table
from spanloom.llm.text import U64, chunks, mix, named, piece_class, windows, word_class

BITS = 15
GRAMS = (1, 2, 3, 4)
#: Slots of the hashed runs; with BITS floats each, this bounds the model.
SLOTS = 1 << 16
#: Labelled samples that the classifiers are fitted on at most: the first by the hash of their id.
MAX_SAMPLES = 20_000
LONG = 15
WINDOW = 6
CHANGE = 4.0
#: Share of the usual evidence per word that a segment must have to be in a language at all.
LEAST_EVIDENCE = 0.35
#: Share of the usual evidence below which a window speaks for no language.
SILENT = 0.15
AMBIGUOUS = 0.9
KEPT_WORDS = 150_000

#: Two-letter codes with their three-letter codes and English names.
NAMES = {
    "de": ("deu", "ger", "german"), "en": ("eng", "english"), "es": ("spa", "spanish"), "fr": ("fra", "fre", "french"), "it": ("ita", "italian"),
    "nl": ("nld", "dut", "dutch"), "pl": ("pol", "polish"), "pt": ("por", "portuguese"), "ru": ("rus", "russian"), "sv": ("swe", "swedish"),
}


def codewords(n: int, bits: int = BITS, seed: int = 7) -> np.ndarray:
    """n rows of +1 and -1 with the greatest least distance among many drawn ones; every bit has
    both values."""
    rng, best, best_key = np.random.default_rng(seed), None, None
    for _ in range(4000):
        code = rng.choice([-1, 1], size=(n, bits))
        if n > 1 and (np.abs(code.sum(axis=0)) == n).any():
            continue
        apart = (bits - code @ code.T) // 2 + np.eye(n, dtype=int) * bits
        key = (int(apart.min()), int(np.abs(code.sum(axis=0)).sum()) * -1)
        if best is None or key > best_key:
            best, best_key = code, key
    return best.astype(np.float32)


def gram_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, slot) of the character runs of each word with its ends marked, in order of word."""
    joined = "".join(f"\x02{w}\x03" for w in words)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(U64)
    sizes = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    of = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))
    all_of, all_slot = [], []
    for n in GRAMS:
        slot = (windows(points, n) ^ mix(np.array([n], dtype=U64))[0]) % U64(SLOTS)
        ok = left[: len(slot)] >= n
        all_of.append(of[: len(slot)][ok])
        all_slot.append(slot[ok].astype(np.int64))
    of, slot = np.concatenate(all_of), np.concatenate(all_slot)
    order = np.argsort(of, kind="stable")
    return of[order], slot[order]


def bare(word: str) -> str:
    """The letters of a word in lower case, with what stands between them."""
    w = word.lower()
    a, b = 0, len(w)
    while a < b and not w[a].isalpha():
        a += 1
    while b > a and not w[b - 1].isalpha():
        b -= 1
    return w[a:b]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # slots x bits
    trust: np.ndarray  # of each bit
    usual: np.ndarray  # evidence per word of a text in each language
    sharp: float

    def margins(self, words: list[str]) -> np.ndarray:
        """Words x bits, each margin within [-3, 3]."""
        out = np.zeros((len(words), BITS), dtype=np.float32)
        for a in range(0, len(words), 5000):
            part = words[a : a + 5000]
            of, slot = gram_slots(part)
            first = np.searchsorted(of, np.arange(len(part)))
            sums = np.add.reduceat(self.weights[slot], first, axis=0)
            empty = np.fromiter((not w for w in part), dtype=bool, count=len(part))
            sums[empty] = 0
            out[a : a + len(part)] = np.clip(sums, -3, 3)
        return out

    def evidence(self, margins: np.ndarray) -> np.ndarray:
        """Words x languages: how much each word speaks for each codeword."""
        return (margins * self.trust) @ self.code.T

    def decode(self, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language number, confidence) of each row of mean margins per word."""
        loss = (self.trust * np.logaddexp(0, -mean[:, None, :] * self.code[None])).sum(axis=2)
        p = np.exp(-self.sharp * (loss - loss.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        return best, p[np.arange(len(p)), best]


def fit(samples: list[tuple[str, str]]) -> Model:
    """A model of (language, text) samples."""
    langs = sorted({x for x, _ in samples})
    if not langs:
        raise ValueError("there are no labelled samples")
    code = codewords(len(langs))
    counts = np.zeros((len(langs), SLOTS), dtype=np.float64)
    texts = [(langs.index(x), [bare(w) for w in t.split()]) for x, t in samples]
    for lang in range(len(langs)):
        words = [w for x, ws in texts if x == lang for w in ws if w]
        np.add.at(counts[lang], gram_slots(words)[1] if words else [], 1)
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)  # languages weigh the same
    smooth = 0.5 / max(1.0, float(np.median(counts.sum(axis=1))))
    weights = np.zeros((SLOTS, BITS), dtype=np.float32)
    known = counts.sum(axis=0) >= 2
    for b in range(BITS):
        yes, no = code[:, b] > 0, code[:, b] < 0
        if yes.any() and no.any():
            weights[known, b] = 0.25 * np.log((share[yes].mean(axis=0)[known] + smooth) / (share[no].mean(axis=0)[known] + smooth))
    model = Model(langs, code, weights, np.ones(BITS, dtype=np.float32), np.ones(len(langs)), 1.0)
    kept = [(x, model.margins(ws)) for x, ws in texts if len(ws) >= LONG]
    pieces = [(x, m[a : a + LONG].mean(axis=0)) for x, m in kept for a in range(0, len(m) - LONG + 1, LONG)] or [(x, m.mean(axis=0)) for x, m in ((x, model.margins(ws)) for x, ws in texts if ws)]
    truth, mean = np.array([x for x, _ in pieces]), np.stack([m for _, m in pieces])
    wrong = ((mean * code[truth]) <= 0).mean(axis=0)
    trust = np.log((1 - wrong + 0.01) / (wrong + 0.01)).clip(0.1)
    model.trust = (trust / trust.mean()).astype(np.float32)
    spoken = model.evidence(mean)[np.arange(len(truth)), truth]
    model.usual = np.array([spoken[truth == k].mean() if (truth == k).any() else spoken.mean() for k in range(len(langs))])
    scores = []
    for sharp in (0.25, 0.5, 1, 2, 4, 8):
        model.sharp = sharp
        best, p = model.decode(mean)
        scores.append((np.where(best == truth, np.log(p), np.log((1 - p).clip(1e-4))).mean(), -sharp))
    model.sharp = -max(scores)[1]
    return model


class _Words:
    """Margins of the words seen, by name; emptied when full."""

    def __init__(self, model: Model):
        self.model = model
        self.at: dict[int, int] = {}
        self.rows = np.zeros((0, BITS), dtype=np.float32)

    def look_up(self, names: np.ndarray, starts: np.ndarray, ends: np.ndarray, joined: str) -> np.ndarray:
        unique, first, inverse = np.unique(names, return_index=True, return_inverse=True)
        if len(self.at) > KEPT_WORDS:
            self.at, self.rows = {}, self.rows[:0]
        keys = unique.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.at]
        if new:
            words = [bare(joined[starts[first[i]] : ends[first[i]]]) for i in new]
            self.at.update((keys[i], len(self.rows) + j) for j, i in enumerate(new))
            self.rows = np.concatenate([self.rows, self.model.margins(words)])
        index = np.fromiter(map(self.at.__getitem__, keys), dtype=np.int64, count=len(keys))
        return self.rows[index][inverse]


def best_sequences(evidence: np.ndarray, bounds: np.ndarray, cost: float) -> np.ndarray:
    """The language of each word on the best path through each text, all texts in step."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    n_langs = evidence.shape[1]
    total = np.zeros((len(order), n_langs), dtype=np.float32)
    came = np.zeros(evidence.shape, dtype=np.int8)
    firsts = bounds[:-1][order]
    alive = len(order)
    longest = int(sizes.max()) if len(sizes) else 0
    for t in range(longest):
        while alive and sizes[order[alive - 1]] <= t:
            alive -= 1
        at = firsts[:alive] + t
        v = total[:alive]
        top = v.argmax(axis=1)
        change = v[np.arange(alive), top] - cost
        switch = change[:, None] > v
        came[at] = np.where(switch, top[:, None], np.arange(n_langs)[None, :])
        total[:alive] = np.where(switch, change[:, None], v) + evidence[at]
    out = np.zeros(len(evidence), dtype=np.int64)
    state = np.zeros(len(order), dtype=np.int64)
    for t in range(longest - 1, -1, -1):
        while alive < len(order) and sizes[order[alive]] > t:
            state[alive] = total[alive].argmax()
            alive += 1
        at = firsts[:alive] + t
        out[at] = state[:alive]
        state[:alive] = came[at, state[:alive]]
    return out


def segments_of(model: Model, words: _Words, texts: list[str]) -> tuple[np.ndarray, ...]:
    """(text, first word, words, language number or -1, confidence) of the segments of each text,
    in order. Words are what stands between blanks and holds a letter or digit."""
    names, starts, ends, bounds, joined = named(texts, piece_class())
    if not len(names):
        return tuple(np.zeros(0, dtype=t) for t in (int, int, int, int, float))
    letters = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sums = np.zeros(len(letters) + 1, dtype=np.int64)
    np.cumsum(word_class()[letters], out=sums[1:])
    real = sums[ends] > sums[starts]
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))[real]
    names, starts, ends = names[real], starts[real], ends[real]
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    margins = words.look_up(names, starts, ends, joined)
    evidence = model.evidence(margins)
    run = np.zeros((len(evidence) + 1, evidence.shape[1]), dtype=np.float64)
    np.cumsum(evidence, axis=0, out=run[1:])
    sizes = np.diff(bounds)
    whole = (run[bounds[1:]] - run[bounds[:-1]]).argmax(axis=1)
    width = min(WINDOW, len(evidence))
    in_window = run[width:] - run[:-width]
    loud = in_window.max(axis=1) >= SILENT * width * float(model.usual.mean())
    in_window = np.where(loud, in_window.argmax(axis=1), -1)
    valid = text[: len(in_window)] == text[width - 1 :]
    differs = np.zeros(len(in_window), dtype=bool)
    differs[valid] = in_window[valid] != whole[text[: len(in_window)]][valid]
    mixed = np.bincount(text[: len(in_window)][differs], minlength=len(texts)) > 0
    spoken = whole[text]
    rows = np.flatnonzero(mixed)
    if len(rows):
        at = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in rows])
        own = np.zeros(len(rows) + 1, dtype=np.int64)
        np.cumsum(sizes[rows], out=own[1:])
        none = np.full((len(at), 1), LEAST_EVIDENCE * float(model.usual.mean()))
        states = np.concatenate([evidence[at], none], axis=1).astype(np.float32)
        spoken[at] = best_sequences(states, own, CHANGE * float(model.usual.mean()))
    new = np.r_[True, (spoken[1:] != spoken[:-1]) | (text[1:] != text[:-1])] if len(spoken) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(spoken)])
    msum = np.zeros((len(margins) + 1, BITS), dtype=np.float64)
    np.cumsum(margins, axis=0, out=msum[1:])
    mean = (msum[first + count] - msum[first]) / count[:, None]
    best, sure = model.decode(mean)
    strength = model.evidence(mean)[np.arange(len(best)), best] / model.usual[best]
    lang = np.where((strength >= LEAST_EVIDENCE) & (spoken[first] < len(model.langs)), best, -1)
    return text[first], first - bounds[text[first]], count, lang, np.where(lang >= 0, sure, 0.0)


def sample_model(samples: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "sample_id", max_samples: int = MAX_SAMPLES) -> Model:
    """A model of at most max_samples labelled samples; null and blank ones are left out."""
    known = samples.select(F.lower(F.trim(lang_col)).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("h")).where("lang != '' and trim(text) != ''")
    rows = known.orderBy("h", "lang", "text").limit(max_samples).collect()
    return fit(sorted((r.lang, r.text) for r in rows))


def language_segments(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, segment, first_word, n_words, lang, confidence, ambiguous): the segments of each text.
    lang is null (confidence 0) where a segment is in no known language; a text that is null or has
    no words gives no row, and every row of docs is judged by itself."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        words = _Words(m)
        names = np.array([*m.langs, None], dtype=object)
        for ids, texts in chunks(batches, ["id", "text"]):
            text, first, count, lang, sure = segments_of(m, words, [t or "" for t in texts])
            number = np.arange(len(text)) - np.searchsorted(text, text) if len(text) else text
            own = np.array([*ids, None], dtype=object)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(own[text]), pa.int64()), pa.array(number.astype(np.int32)), pa.array(first.astype(np.int64)), pa.array(count.astype(np.int64)), pa.array(list(names[lang]), pa.string()), pa.array(np.round(sure, 6)), pa.array((sure < AMBIGUOUS) & (lang >= 0))],
                names=["id", "segment", "first_word", "n_words", "lang", "confidence", "ambiguous"],
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id bigint, segment int, first_word bigint, n_words bigint, lang string, confidence double, ambiguous boolean").withColumnRenamed("id", id_col)


def written_in(segments: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, langs): the languages that a text has a segment of LONG words or more in; a row for
    each text with at least one."""
    return segments.where((F.col("n_words") >= LONG) & F.col("lang").isNotNull()).groupBy(id_col).agg(F.sort_array(F.collect_set("lang")).alias("langs"))


def stated(label: Column) -> Column:
    """The two-letter code of the language that a label states, else null."""
    base = F.regexp_extract(F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", "")), r"^([a-z]+)(?:[-_].*)?$", 1)
    codes = F.lit(None).cast("string")
    for two, others in NAMES.items():
        codes = F.when(base.isin(two, *others), F.lit(two)).otherwise(codes)
    return codes


def wrong_labels(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(id, lang): each language of every text whose label doesn't state the one language that it
    is written in, or that is written in several. Texts in no language are left out."""
    labels = docs.select(F.col(id_col).alias("id"), stated(F.col(label_col)).alias("stated"))
    langs = written_in(language_segments(docs, model, id_col, text_col).withColumnRenamed(id_col, "id"), "id")
    met = langs.join(labels, "id").where("size(langs) > 1 or stated is null or stated != langs[0]")
    return met.select(F.col("id").alias(id_col), F.explode("langs").alias("lang")).distinct()


def _model(spark: SparkSession, sf_dir: str) -> Model:
    return sample_model(table(spark, sf_dir, "lang_samples"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return wrong_labels(docs, _model(spark, sf_dir))


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return language_segments(docs, _model(spark, sf_dir))


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its main language, the words and the confidence of its parts in it, and
    the number of its languages; null and 0 for a text in none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = language_segments(docs, _model(spark, sf_dir)).where("lang is not null")
    per_lang = parts.groupBy("doc_id", "lang").agg(F.sum("n_words").alias("words"), F.max("n_words").alias("longest"), (F.sum(F.col("confidence") * F.col("n_words")) / F.sum("n_words")).alias("confidence"))
    best = per_lang.groupBy("doc_id").agg(F.max_by(F.struct("lang", "words", "confidence"), F.struct("words", "lang")).alias("m"), F.sum((F.col("longest") >= LONG).cast("int")).alias("n_langs"))
    rows = docs.select("doc_id").join(best, "doc_id", "left")
    return rows.select("doc_id", "m.lang", F.coalesce("m.words", F.lit(0).cast("bigint")).alias("words"), F.round(F.coalesce("m.confidence", F.lit(0.0)), 6).alias("confidence"), F.coalesce("n_langs", F.lit(0).cast("bigint")).alias("n_langs"))
