import collections
import hashlib
import itertools
import math
import random
import zlib

import corpus_pipeline
import numpy as np
import pytest

from sedira.llm import langid, packing
from tests.llm.test_corpus_ops import ASCII_LOWER, WORD, brute, by_hand, removed_by_hand, sentences, words

LANGUAGES = ["en", "fr", "fi", "nl", "pl", "sv", "tr"]


def test_stages(spark, documents, tmp_path):
    docs = documents.withColumnRenamed("size", "n_chars")
    columns = docs.columns
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == columns and out.count() > 0
        kept = out
    assert kept.count() == corpus_pipeline.run(spark, str(tmp_path)).count()
    size = collections.Counter()
    for r in kept.collect():
        size[r["sequence_id"]] += r["length"]
    assert max(size.values()) <= 2048


def test_empty(spark, documents, tmp_path):
    documents.where("false").withColumnRenamed("size", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


# ---- every stage by hand, each on its own input -----------------------------------------------------------------


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text, lang, source, n_chars, score): five languages, near and exact copies, passages, junk, nulls."""
    rng = random.Random(11)
    letters = {lang: rng.sample("abcdefghijklmnopqrstuvwxy", 9) for lang in LANGUAGES}
    vocab = {lang: ["".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 8))) for _ in range(300)] for lang in LANGUAGES}
    say = lambda lang, n: " ".join(rng.choice(vocab[lang]) for _ in range(n)).capitalize() + "."
    tell = lambda lang, n: " ".join(say(lang, rng.randint(4, 15)) for _ in range(n))
    texts = [(tell(lang, rng.randint(2, 12)), lang) for lang in LANGUAGES for _ in range(24)]
    for t, lang in texts[::6]:
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts += [(" ".join(w), lang), (t, lang)]
    passage = {lang: " ".join(say(lang, 9) for _ in range(7)) for lang in LANGUAGES}
    texts += [(f"{tell(lang, 3)}\n{passage[lang]}\n{tell(lang, 2)}", lang) for lang in LANGUAGES for _ in range(5)]
    # two halves that others begin with: the last document has nothing else, after a line break
    left, right = tell("en", 9), tell("en", 9)
    texts += [(f"{left} {tell('en', 9)}", "en"), (f"{tell('en', 9)} {right}", "en"), (f"\n\t{left} {right}", None)]
    texts += [(f"{tell('fr', 4)} {tell('tr', 4)}", None), (tell("pl", 400), "pl"), ("z.", None), ("12 ½ !!", "en"), ("", None), (None, "en"), ("\n", None)]
    rows = [(3 * k + 1, t, lang if k % 4 else None, ["web", "books", None, "code"][min(k % 7, 3)], len(t or ""), 0.5) for k, (t, lang) in enumerate(texts)]
    rows += [rows[0], rows[-1], (None, tell("nl", 5), None, "books", None, None), (None, None, None, None, None, None)]
    return rows


def languages_by_hand(rows):
    """The rows that stay: the model, the best path and the sureness of its spans from their definitions."""
    find = langid.word_pattern().findall
    known = {(lang, t) for _, t, lang, *_ in rows if t is not None and lang is not None}
    names = sorted({lang for lang, _ in known})
    counts, scripts = {lang: collections.Counter() for lang in names}, {lang: collections.Counter() for lang in names}
    for lang, t in known:
        for w in find(t.lower()):
            scripts[lang][langid.script(w)] += 1
            counts[lang].update(f"<{w}>"[k : k + 3] for k in range(len(w)))
    every = len(set().union(*counts.values()))
    base = {lang: math.log(sum(counts[lang].values()) + every + 1) for lang in names}
    spoken = {lang: {s for s, n in scripts[lang].items() if n >= 0.01 * sum(scripts[lang].values())} for lang in names}

    def stays(t):
        found = find((t or "").lower())
        if not found:
            return False
        score = []
        for w in found:
            allowed = [x for x in names if langid.script(w) in spoken[x]] or names
            score.append({x: sum(math.log(counts[x][f"<{w}>"[k : k + 3]] + 1) - base[x] for k in range(len(w))) if x in allowed else -1e9 for x in names})
        best, back = dict(score[0]), []
        for s in score[1:]:
            top = max(best, key=best.get)
            back.append({x: x if best[x] >= best[top] - langid.SWITCH else top for x in names})
            best = {x: best[back[-1][x]] - (back[-1][x] != x) * langid.SWITCH + s[x] for x in names}
        path = [max(best, key=best.get)]
        for b in reversed(back):
            path.append(b[path[-1]])
        at, sure, n = 0, 0.0, sum(map(len, found))
        for lang, run in itertools.groupby(reversed(path)):
            to = at + len(list(run))
            total = {x: sum(s[x] for s in score[at:to]) for x in names}
            sure += sum(map(len, found[at:to])) / sum(math.exp(min(700, v - total[lang])) for v in total.values())
            at = to
        return sure / n >= corpus_pipeline.LEAST_SURE

    kept = {t: stays(t) for _, t, *_ in rows}
    return [r for r in rows if kept[r[1]]]


def duplicates_by_hand(rows):
    once = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    found = brute(list(enumerate(r[1] for r in once)), 5, 80)
    return [r for k, r in enumerate(once) if found[k][1] == k]


def passages_by_hand(rows):
    gone = removed_by_hand([r[:2] for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))], 24)
    out = []
    for r in rows:
        found = gone[r[0], r[1]][1]
        if not found:
            out.append(r)
            continue
        place, starts, at = [m.start() for m in WORD.finditer(r[1])], [], 0
        for s in sentences(r[1].translate(ASCII_LOWER)):
            starts.append(place[at])
            at += len(s)
        starts.append(len(r[1]))
        text = r[1][: starts[0]] + "".join(r[1][a:b] for k, (a, b) in enumerate(itertools.pairwise(starts)) if k not in found)
        if words(text):
            out.append((r[0], text, *r[2:4], len(text), *r[5:]))
    return out


def mix_by_hand(rows):
    """Rows are told apart by id and text here, so each takes a draw of its own."""
    assert len({r[:2] for r in rows}) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    target, out = by_hand(dict(sizes)), []
    for r in rows:
        rate = target[r[3]] / sizes[r[3]]
        u = int(hashlib.md5(f"2:{'' if r[0] is None else r[0]}:{r[1]}".encode()).hexdigest()[:13], 16) / 2**52
        out += [r] * (math.floor(rate) + (u < rate - math.floor(rate)))
    return out


def pieces_by_hand(rows):
    from tokenizers import Tokenizer

    whole, out = Tokenizer.from_file(packing.default_tokenizer()), []
    for r in rows:
        ids = whole.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            p = np.array(ids[k : k + 2048], "<u4")
            out.append((r[0], k // 2048, k, len(p), zlib.crc32(p.tobytes())))
    return out


def test_every_stage_by_hand(spark, corpus, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars", "score"]
    docs = spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string, n_chars long, score double").repartition(5)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows, size = list(corpus), []
    by = [languages_by_hand, duplicates_by_hand, passages_by_hand, mix_by_hand]
    for (name, stage), hand in zip(corpus_pipeline.STAGES, by):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs, rows = spark.read.parquet(f"{tmp_path}/{name}"), hand(rows)
        assert docs.columns == columns
        assert collections.Counter(map(tuple, docs.collect())) == collections.Counter(rows), name
        size.append(len(rows))
    # each stage had something to do, and what it was given to keep is there
    unsure = next(r[0] for r in corpus if r[1] == "z.")  # as likely in any language
    left = {r[0] for r in rows}
    assert size[0] < len(corpus) and size[1] < size[0] - 30 and size[2] < size[1] and size[3] != size[2]
    nothing_else = next(r[0] for r in corpus if (r[1] or "").startswith("\n\t"))
    assert not {unsure, nothing_else} & left and None in left
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == collections.Counter(pieces_by_hand(rows))
    places = collections.defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in places.values():
        s.sort()
        assert [a for a, _ in s] == [0, *itertools.accumulate(n for _, n in s)][:-1] and sum(n for _, n in s) <= 2048
    assert len(places) <= -(-sum(r["length"] for r in got) // 2048) * 1.03 + 1
