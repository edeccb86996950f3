"""Language identification of mixed-language text: script ranges, per-word scores, Viterbi.

A model is learned from labelled texts: for each language, log probabilities of character trigrams of words (with word
ends) under add-one smoothing, and the scripts its words are written in. Words are runs of letters and their marks, in
lower case. A word's script leaves the languages that were seen in that script (all, if none was); each gets the word's log
likelihood, and Viterbi with a penalty for every switch labels the words of the whole text, so that spans of one language
come out. A span is as sure as the posterior of its language given all its words. The prediction is the language with most
letters in its spans; the score is the mean sureness of all letters, where those of other languages' spans count as 0, and
`sure` is the same with all spans counted, which a text in several languages does not lower.

The model is fitted on a bounded sample of labelled rows, `SAMPLE` texts a language, taken by a hash of the text; the texts
are counted where they lie, and the driver gets the distinct trigrams of each language. Words are scored by a table that is
filled as words occur, with a bound on its memory only.

Cases: a null text, or one without letters (numerals such as ² or Ⅷ are none), is `und` with score 0; rows without a
language are not learned from; without any labelled row every text with letters is `und`; repeated rows count once in the
sample; very long texts are labelled whole. `identify` keeps other columns in a struct.
"""

from __future__ import annotations

import functools
import math
import re
import sys
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedira.llm.common import Scratch, doc_crc, lean, read

SAMPLE = 600
#: Languages whose counts are broadcast at most.
BROADCAST = 1 << 16
SWITCH = 6.0
UNKNOWN = "und"
#: Words whose scores a worker remembers between slices of texts; numbers (of words times languages) that are held at once.
CACHE_WORDS, NUMBERS = 200_000, 1 << 20
#: First code points of runs of one script, and the script (fixed values: the blocks of the public code charts, summarily).
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "indic"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x1780, "khmer"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "latin"), (0x2C60, "latin"),
    (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"),
    (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB10, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x20000, "han"),
]
_FIRST = [s for s, _ in SCRIPTS]
#: More than any code point.
GRAM_BASE = 1 << 21
_EXCLUDED = -1e9


@functools.cache
def word_pattern() -> re.Pattern:
    """A letter (general category L) and the letters and marks (M) after it."""

    def ranges(kinds: str) -> str:
        inside = np.array([unicodedata.category(chr(c))[0] in kinds for c in range(sys.maxunicode + 1)])
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edge.reshape(-1, 2))

    return re.compile(f"[{ranges('L')}][{ranges('LM')}]*")


def script(word: str) -> str:
    return SCRIPTS[bisect_right(_FIRST, ord(word[0])) - 1][1]


class _Ids(dict):
    """Numbers of words in the order they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # trigrams as numbers, sorted
    weights: np.ndarray  # of each trigram and language; the last row is for those never seen
    scripts: dict[str, np.ndarray]
    switch: float = SWITCH
    ids: _Ids = field(default_factory=_Ids)  # words met, and their scores and letters
    scores: np.ndarray | None = None
    letters: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"ids": _Ids(), "scores": None, "letters": None}

    def forget(self) -> None:
        self.ids, self.scores, self.letters = _Ids(), np.zeros((0, len(self.languages)), np.float32), np.zeros(0, np.int32)

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The words of each text as rows of `scores`, which holds all of them then."""
        if self.scores is None or len(self.ids) > CACHE_WORDS:
            self.forget()
        words, number = word_pattern().findall, self.ids.__getitem__
        out = [np.fromiter(map(number, words(t.lower())), np.int32) for t in texts]
        if len(self.ids) > len(self.scores):
            new = list(self.ids)[len(self.scores) :]
            at = 0
            scores = [self.scores]
            while at < len(new):
                part = new[at : at + max(1, NUMBERS // (8 * len(self.languages)))]
                scores.append(self._scored(part))
                at += len(part)
            self.scores = np.concatenate(scores)
            self.letters = np.concatenate([self.letters, np.array([len(w) for w in new], np.int32)])
        return out

    def _scored(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each language less the best one's; very low where the script rules a language out."""
        points = np.frombuffer(f"<{'><'.join(words)}>".encode("utf-32-le"), np.uint32).astype(np.int64)
        n = np.array([len(w) for w in words])  # trigrams of a word and its two ends
        at = np.cumsum(n + 2) - n - 2
        gram = (points[:-2] * GRAM_BASE + points[1:-1]) * GRAM_BASE + points[2:]
        keep = np.ones(len(points), bool)
        keep[at + n] = keep[at + n + 1] = False  # those that reach into the next word
        gram = gram[keep[:-2]]
        i = np.minimum(np.searchsorted(self.grams, gram), max(0, len(self.grams) - 1))
        row = np.where(self.grams[i] == gram, i, len(self.grams)) if len(self.grams) else np.zeros(len(gram), np.int64)
        s = np.add.reduceat(self.weights[row], np.cumsum(n) - n)
        every = np.ones(len(self.languages), bool)
        allowed = np.array([self.scripts.get(k, every) for _, k in SCRIPTS])
        s[~allowed[np.searchsorted(_FIRST, points[at + 1], "right") - 1]] = _EXCLUDED
        return s - s.max(1, keepdims=True)


def gram_number(gram: str) -> int:
    a, b, c = map(ord, gram)
    return (a * GRAM_BASE + b) * GRAM_BASE + c


def fit(sample: DataFrame, switch: float = SWITCH) -> Model:
    """`sample`: text, lang. Trigrams and scripts are counted by language where the texts are; what is fetched is bounded by the trigrams of each language's words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for b in batches:
            for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                words.setdefault(lang, Counter()).update(word_pattern().findall(t.lower()))
        out: Counter = Counter()
        for lang, found in words.items():
            for word, n in found.items():
                out[lang, True, script(word)] += n
                w = f"<{word}>"
                for i in range(len(word)):
                    out[lang, False, w[i : i + 3]] += n
        if out:
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.string()), pa.array(list(out.values()), pa.int64())], ["lang", "is_script", "item", "n"])

    table = sample.select("text", "lang").mapInArrow(lean(count), "lang string, is_script boolean, item string, n long").groupBy("lang", "is_script", "item").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["lang"].unique())
    grams, scripts = table[~table["is_script"].astype(bool)], table[table["is_script"].astype(bool)]
    column = {x: k for k, x in enumerate(languages)}
    every, row = np.unique(np.array([gram_number(g) for g in grams["item"]], np.int64), return_inverse=True)
    counts = np.zeros((len(every) + 1, len(languages)))
    counts[row, grams["lang"].map(column).to_numpy(int)] = grams["n"]
    base = np.log(counts.sum(0) + len(every) + 1)
    seen: dict[str, np.ndarray] = {}
    total = scripts.groupby("lang")["n"].sum()
    for lang, item, n in zip(scripts["lang"], scripts["item"], scripts["n"]):
        if n >= 0.01 * total[lang]:
            seen.setdefault(item, np.zeros(len(languages), bool))[column[lang]] = True
    return Model(list(languages), every, (np.log(counts + 1.0) - base).astype(np.float32), seen, switch)


def sample(docs: DataFrame, each: int = SAMPLE) -> DataFrame:
    """Up to `each` distinct labelled texts of each language, those with the least hash: one partial aggregate of hashes, then one selective read."""
    labelled = docs.where("lang is not null and text is not null").select("lang", "text").withColumn("h", F.xxhash64("text"))
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    # a hash is uniform: this share of its range holds some more than `each` texts, of which the least `each` are taken
    share = F.least(F.lit(1.0), (F.lit(each) + 4 * math.sqrt(each)) / F.col("n"))
    counts = Scratch(docs.sparkSession).keep(counts, "counts")
    counts = F.broadcast(counts) if counts.count() <= BROADCAST else counts  # a row a language
    chosen = labelled.join(counts, "lang").where((F.pmod("h", F.lit(1 << 40)) / float(1 << 40)) < share).dropDuplicates(["lang", "h"])
    from pyspark.sql import Window

    return chosen.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 40)), "h"))).where(F.col("r") <= each).select("lang", "text")


def viterbi(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """The language of every word of texts (numbers of words, longest text first), one text after the other. The step for the i-th word is taken for all texts that have one; of each step a bit a language is kept (whether its best path stays) and the best language."""
    L = len(model.languages)
    n = np.array([len(t) for t in texts])
    flat, at = np.concatenate(texts), np.concatenate([[0], np.cumsum(n)[:-1]])
    stays, tops = np.zeros((len(flat), -(-L // 8)), np.uint8), np.zeros(len(flat), np.int32)
    best = model.scores[flat[at]].copy()
    alive = len(n)
    for i in range(1, int(n[0])):
        while n[alive - 1] <= i:
            alive -= 1
        b, here = best[:alive], at[:alive] + i
        top = b.argmax(1)
        jump = b[np.arange(alive), top] - model.switch
        stay = b >= jump[:, None]
        stays[here], tops[here] = np.packbits(stay, axis=1), top
        best[:alive] = np.where(stay, b, jump[:, None]) + model.scores[flat[here]]
    path = np.empty(len(flat), np.int32)
    now = best.argmax(1).astype(np.int32)
    for i in range(int(n[0]) - 1, -1, -1):
        alive = int(np.searchsorted(-n, -i, "left"))  # texts with more than i words
        here, own = at[:alive] + i, now[:alive]
        path[here] = own
        if i:
            stay = stays[here, own >> 3] >> (7 - (own & 7)) & 1
            now[:alive] = np.where(stay, own, tops[here])
    return path


def _sure(model: Model, flat: np.ndarray, path: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Posterior of the language of each span given its words; `first`: where spans start."""
    sums = np.zeros((len(first), len(model.languages)))
    step = max(1, NUMBERS // len(model.languages))
    for a in range(0, len(flat), step):
        lo, hi = np.searchsorted(first, a, "right") - 1, np.searchsorted(first, min(len(flat), a + step), "left")
        cut = np.maximum(first[lo:hi], a) - a
        sums[lo:hi] += np.add.reduceat(model.scores[flat[a : a + step]], cut)
    sums -= sums[np.arange(len(first)), path[first]][:, None]
    return 1 / np.exp(np.minimum(sums, 700)).sum(1)


def label(model: Model, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
    """lang_pred, score and sure of each text."""
    L = len(model.languages)
    out, score, sure = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    if not L:
        return out, score, sure
    words = model.numbers([t or "" for t in texts])
    order = sorted((k for k in range(len(texts)) if len(words[k])), key=lambda k: -len(words[k]))
    if not order:
        return out, score, sure
    words = [words[k] for k in order]
    path = viterbi(model, words)
    n, flat = np.array([len(w) for w in words]), np.concatenate(words)
    doc = np.repeat(np.arange(len(n)), n)
    first = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])]))
    posterior = _sure(model, flat, path, first)
    letters = np.add.reduceat(model.letters[flat].astype(np.int64), first)
    of, lang = doc[first], path[first]
    share = np.bincount(of * L + lang, letters, len(n) * L).reshape(len(n), L)
    win, total = share.argmax(1), share.sum(1)
    mine = lang == win[of]
    value = np.bincount(of[mine], (posterior * letters)[mine], len(n)) / total
    whole = np.bincount(of, posterior * letters, len(n)) / total
    for r, k in enumerate(order):
        out[k], score[k], sure[k] = model.languages[win[r]], float(min(1.0, value[r])), float(min(1.0, whole[r]))
    return out, score, sure


def spans(model: Model, text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, language) of the spans of one text, in characters, from the first word of each to its last."""
    found = list(word_pattern().finditer(text or ""))
    if not found or not model.languages:
        return []
    path = viterbi(model, [np.concatenate(model.numbers([m.group() for m in found]))])
    out: list[tuple[int, int, str]] = []
    for m, p in zip(found, path):
        if out and out[-1][2] == model.languages[p]:
            out[-1] = (out[-1][0], m.end(), out[-1][2])
        else:
            out.append((m.start(), m.end(), model.languages[p]))
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc (struct of the input's columns), lang_pred, score, sure. The model (a few MB, bounded by the sample) is broadcast; there is no exchange."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def labelled(values: list[str | None], m: Model) -> Iterator[tuple[list[int], tuple]]:
        order = sorted(range(len(values)), key=lambda k: -len(values[k] or ""))  # long ones together
        limit, at = max(1 << 16, 4 * NUMBERS // max(4, len(m.languages))), 0
        while at < len(order):
            to, size = at, 0
            while to < len(order) and (to == at or size < limit):
                size += len(values[order[to]] or "")
                to += 1
            yield order[at:to], label(m, [values[k] for k in order[at:to]])
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = b.column("doc")
            values = pc.struct_field(doc, text).to_pylist()
            pred, score, sure = [UNKNOWN] * len(values), np.zeros(len(values)), np.zeros(len(values))
            for rows, (p, s, u) in labelled(values, shared.value):
                for k, x in zip(rows, p):
                    pred[k] = x
                score[rows], sure[rows] = s, u
            yield pa.RecordBatch.from_arrays([doc, pa.array(pred), pa.array(score), pa.array(sure)], ["doc", "lang_pred", "score", "sure"])
        shared.value.forget()  # the worker lives on

    docs = docs.select(F.struct("*").alias("doc"))
    kind = docs.schema["doc"].dataType
    text = next(k for k, f in enumerate(kind.fields) if f.name.lower() == "text")
    out = T.StructType([T.StructField("doc", kind), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("sure", T.DoubleType())])
    return docs.mapInArrow(lean(run), out)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", spread=True).select("doc_id", "text", "lang")
    held_out = F.coalesce(doc_crc() % 3 == 1, F.lit(False))
    model = fit(sample(docs.where(~held_out)))
    return identify(docs.select("doc_id", "text"), model).select("doc.doc_id", held_out_of("doc.doc_id").alias("held_out"), "lang_pred", "score")


def held_out_of(column: str):
    return F.coalesce(doc_crc(column) % 3 == 1, F.lit(False))
