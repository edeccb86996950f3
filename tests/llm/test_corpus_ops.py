"""Each operator on hard rows, against brute force where SQL cannot say it."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from sedira.llm import brown, fingerprints, jaccard, langid, licenses, mixing, packing, sharding, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(ASCII_LOWER))


# ---- licences ----------------------------------------------------------------------------------------------------


def test_license_forms_match(spark):
    mit = licenses.KNOWN["MIT"]
    changed = "Copyright (c) 2020 Someone\n" + mit.upper().replace(",", " ;").replace("WITHOUT LIMITATION", "WITHOUT\n  LIMITATION") + "\n(c) 2021 others"
    docs = spark.createDataFrame([(1, mit, 0), (2, changed, 0), (3, mit + " more", 0), (4, None, 0), (5, "", 0), (6, "Copyright 2020 X", 0), (1, mit, 0)], "doc_id long, text string, digest int")
    got = {r["doc"]["doc_id"]: (r["digest"], r["license_id"]) for r in licenses.scan(docs, licenses.known(spark)).collect()}
    assert got[1] == got[2] and got[1][1] == "MIT"
    assert got[3][1] is None and got[3][0]
    assert got[4] == got[5] == got[6] == (None, None)
    assert licenses.scan(docs.where("false"), licenses.known(spark)).count() == 0
    assert licenses.scan(docs, licenses.known(spark)).count() == 7


APACHE_4 = "4. Redistribution. You may reproduce copies provided that You meet the following conditions:\n(a) You must give recipients a copy of this License; and\n(b) You must cause modified files to carry notices; and\n(c) You must retain, in the Source form, all copyright notices; and\n(d) If the Work includes a NOTICE file"


def test_license_forms(spark):
    """What counts as the same text, and what does not."""
    isc, mit = licenses.KNOWN["ISC"], licenses.KNOWN["MIT"]
    wrapped = isc.replace("provided that the above copyright", "provided that the above\ncopyright")
    same = [
        ("a licence licence copy", "a license license copy"),
        ("\u201cAS IS\u201d \u2014 it\u2019s", '"AS IS" - it\'s'),
        ("the copyright owner may sub-license per cent", "The copyright holder may sublicense percent."),
        ("x\n(c) 2020 Some One\n \u00a9 Other\n * Copyright (C) Third\n# Copyright [yyyy] [name]\ny", "x y"),
        (wrapped, isc),
        ("The MIT License (MIT)\n\nCopyright (c) 2020 Me\nAll rights reserved.\n\n" + mit, mit),
    ]
    other = [("x\n(c) you must retain\ny", "x\ny"), (APACHE_4, APACHE_4.replace("retain", "drop")), ("copyright holders be liable", "be liable"), ("x2", "x\u00b2"), ("no license", "no licenses")]
    rows = [(2 * k + j, t[j]) for k, t in enumerate(same + other) for j in (0, 1)]
    got = {r["n"]: r["digest"] for r in licenses.with_digest(spark.createDataFrame(rows, "n int, text string"), ["n"]).collect()}
    for k in range(len(same)):
        assert got[2 * k] == got[2 * k + 1], same[k]
    for k in range(len(same), len(same) + len(other)):
        assert got[2 * k] != got[2 * k + 1], rows[2 * k]


def test_license_scan_agrees_with_sql(spark):
    """Whole licences, near misses and lines, with the SQL of the query."""
    import duckdb

    texts = [None, "", "Copyright 2020 X", "no licence here"]
    for k, t in licenses.KNOWN.items():
        texts += [t, f"MIT License\n\nCopyright (c) 2021 {k}\n\n" + t.replace(" ", "\n", 3).upper(), t + " more", "Before.\n" + t + "\nAfter, under a licence."]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(0, None, "y"), (4, texts[4], "y")], "doc_id long, text string, license_id string").repartition(3)
    got = sorted((r["doc"]["doc_id"], r["digest"] or "", r["license_id"] or "", ",".join(r["line_licenses"])) for r in licenses.scan(docs, licenses.known(spark)).collect())
    documents = docs.toPandas()  # noqa: F841
    want = sorted((a, b or "", c or "", d) for a, b, c, d in duckdb.sql(licenses.ORACLE_OP1).fetchall())
    assert got == want
    found = {r[2] for r in got if r[2]}
    assert found == set(licenses.KNOWN) and {r[3] for r in got} >= {"GPL-3.0-notice", "Apache-2.0-notice"}
    assert sum(r[2] != "" for r in got) == 2 * len(licenses.KNOWN) + 1


def test_longer_licenses(spark):
    import os

    folder = "/usr/share/common-licenses"
    have = [k for k in ("Apache-2.0", "MPL-2.0", "CC0-1.0") if os.path.exists(f"{folder}/{k}")]
    rows = [(k, open(f"{folder}/{k}", encoding="utf-8").read()) for k in have]
    if rows:
        got = licenses.scan(spark.createDataFrame(rows, "name string, text string"), licenses.known(spark)).collect()
        assert all(r["license_id"] == r["doc"]["name"] for r in got)


# ---- mixing ------------------------------------------------------------------------------------------------------


def by_hand(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(capped.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > 3 * sizes[s] + 1e-9]
        if not over:
            return {s: capped.get(s, weight[s] * level if s in free else 0) for s in order}
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_mixing(documents):
    rows = mixing.plan(documents).collect()
    assert len(rows) == documents.count()
    sizes = collections.Counter()
    for r in rows:
        assert r["mix_size"] == len(words(r["text"]))
        sizes[r["source"]] += r["mix_size"]
    want = by_hand(dict(sizes))
    for r in rows:
        assert r["mix_source_size"] == sizes[r["source"]]
        assert r["mix_target"] == pytest.approx(want[r["source"]])
        assert abs(r["mix_copies"] - r["mix_target"] / max(1, r["mix_source_size"])) < 1 or not r["mix_source_size"]
    out = mixing.mix(documents)
    assert out.columns == documents.columns and out.count() == sum(r["mix_copies"] for r in rows)
    assert mixing.mix(documents).exceptAll(out).count() == 0
    assert mixing.mix(documents.where("false")).count() == 0


def test_mixing_stops_at_three_times(spark):
    docs = spark.createDataFrame([(k, "a b c d " * (50 if s == "a" else 1), s) for k, s in enumerate(["a"] * 50 + ["b", "c"] * 5)], "doc_id long, text string, source string")
    rows = mixing.plan(docs).collect()
    assert {r["mix_copies"] for r in rows if r["source"] != "a"} == {3}
    assert all(r["mix_target"] == 3 * r["mix_source_size"] for r in rows if r["source"] != "a")


def test_mixing_of_repeated_rows(spark):
    """A source may be one repeated row: its copies share what it takes."""
    docs = spark.createDataFrame([(k % 3, "a b c d e", "xyz"[k % 3]) for k in range(3000)] + [(None, None, None), (9, "other", "x")], "doc_id long, text string, source string").repartition(4)
    rows = mixing.plan(docs).collect()
    taken, target = collections.Counter(), {}
    for r in rows:
        taken[r["source"]] += r["mix_copies"] * r["mix_size"]
        target[r["source"]] = r["mix_target"]
    assert all(abs(taken[s] - target[s]) <= 10 for s in "xyz") and len(rows) == 3002
    assert mixing.mix(docs).exceptAll(mixing.mix(docs.repartition(7))).count() == 0


# ---- packing -----------------------------------------------------------------------------------------------------


def test_packing(documents):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    whole = Tokenizer.from_file(path)
    got = packing.pack_documents(documents, path, length=128, with_ids=True).collect()
    pieces = collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    want = collections.Counter()
    for r in documents.collect():
        ids = whole.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 128):
            p = np.array(ids[k : k + 128], "<u4")
            want[r["doc_id"], k // 128, k, len(p), zlib.crc32(p.tobytes())] += 1
    assert pieces == want
    seq = collections.defaultdict(list)
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seq.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 128
    assert len(seq) <= -(-sum(r["length"] for r in got) // 128) * 1.03 + 1
    assert packing.pack_documents(documents.where("false"), path).count() == 0


def test_other_tokenizers_encode_whole_texts():
    import json

    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    e = packing.Encoder(path)
    assert not e.by_chunks
    for t in ["One, two. Three", " a  b", "it's 12.5, é."]:
        assert np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() == e.encode(t)
    with open(packing.default_tokenizer()) as f:
        known = json.load(f)
    assert packing.by_chunks(known)
    assert not packing.by_chunks(known | {"normalizer": None}) and not packing.by_chunks(known | {"added_tokens": [{"content": "x"}]})


def test_packing_plan_is_whole():
    rng = np.random.default_rng(3)
    for hist in ({5: 3}, {2048: 4, 1: 1}, {1025: 7}, {int(k): int(n) for k, n in zip(rng.integers(1, 2049, 300), rng.integers(1, 40, 300))}):
        plan = packing.strategy(hist)
        used = collections.Counter()
        for n, inside in plan:
            assert sum(inside) <= 2048
            for x in inside:
                used[x] += n
        assert used == hist
        assert sum(n for n, _ in plan) <= max(sum(n for k, n in hist.items() if k > 1024), math.ceil(sum(k * n for k, n in hist.items()) / 2048)) * 1.03 + 2


def test_encoder_equals_tokenizer():
    e = packing.Encoder(packing.default_tokenizer())
    assert e.by_chunks
    every = [c for c in [*range(0x3400), *range(0xA000, 0xAC10), *range(0xF900, 0x10000), *range(0x1D100, 0x1D200), *range(0x1F100, 0x1F200), *range(0x2F800, 0x2F900)]]
    for form in ("a%s. B", "%s,"):
        texts = [form % chr(c) for c in every]
        for t, whole in zip(texts, e.tokenizer.encode_batch(texts, add_special_tokens=False)):
            assert np.array(whole.ids, "<u4").tobytes() == e.encode(t), hex(ord(t[form.index("%")]))
    for t in ["İstanbul ΑΣ. it's we've, 'd <|endoftext|>x a\x1cb", "Ｆｕｌｌ １２３,. a... b.,c d'll. é. x_. ½. ² a²,  z", "<|STARTOFTEXT|>, don't. 'S", "", "́x. ,", "ß. Œ, œuvre. дом, дом. 中文。"]:
        assert np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() == e.encode(t)


# ---- sharding ----------------------------------------------------------------------------------------------------


def test_sharding(spark, documents):
    copies = spark.createDataFrame([(10_000 + k, "the same text", "a", None, 0, "", 0.0) for k in range(600)], documents.schema)
    docs = documents.where("length(text) < 10000 or text is null").unionByName(copies)
    got = sharding.shard(docs, 5, rows_per_task=40).collect()
    assert len(got) == docs.count()
    total, size, slots = 0, collections.Counter(), collections.defaultdict(list)
    for r in got:
        raw = (r["doc"]["text"] or "").encode()
        assert r["shard_size"] == len(raw) + 8 and r["shard_crc"] == zlib.crc32(raw)
        size[r["shard"]] += r["shard_size"]
        slots[r["shard"]].append(r["slot"])
        total += r["shard_size"]
    assert set(size) == set(range(5)) and all(abs(n - total / 5) < 0.02 * total + 3000 for n in size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(docs.where("false"), 5).count() == 0
    where = collections.defaultdict(set)
    for r in got:
        where[r["doc"]["text"] or ""].add(r["shard"])
    assert sum(len(s) > 1 for s in where.values()) <= 4  # only a boundary cuts a group


def test_sharding_of_repeated_rows(spark):
    """Rows equal in id and text, which are most of the table and more than a shard, with names that clash."""
    rows = [(7, "abcd", 1)] * 2000 + [(k, f"t{k}", 1) for k in range(398)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(3)
    got = sharding.shard(docs).collect()
    assert sorted((r["doc"]["doc_id"], r["doc"]["text"], r["doc"]["slot"]) for r in got) == sorted(rows)
    size, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        size[r["shard"]] += r["shard_size"]
        slots[r["shard"]].append(r["slot"])
    total = sum(size.values())
    assert set(size) == set(range(24)) and all(abs(n - total / 24) <= 2 * (0.005 * total / 24 + 12) for n in size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(docs.withColumn("doc_id", __import__("pyspark").sql.functions.lit(None).cast("long")), 3).count() == len(rows)


# ---- substrings --------------------------------------------------------------------------------------------------


def sentences(t):
    found = [(m.group(), m.start(), m.end()) for m in WORD.finditer(t)]
    out, cur = [], []
    for k, (w, _, e) in enumerate(found):
        cur.append(w)
        x = w
        for _ in range(3):
            if len(x) > 1 and x[-1] in "\"')]}":
                x = x[:-1]
        if x[-1] in ".!?" or k == len(found) - 1 or "\n" in t[e : found[k + 1][1]]:
            out.append(cur)
            cur = []
    return out


def removed_by_hand(rows, least):
    """rows: (doc_id, text), each one once, in order. What goes, as (sentences, indices of those that go) of each row."""
    seen, out = {}, {}
    for i, t in rows:
        s = sentences((t or "").translate(ASCII_LOWER))
        runs = set()
        for a in range(len(s)):
            for step in (1, -1):
                b, c = a, 0
                while 0 <= b < len(s):
                    c += len(s[b])
                    if c >= least and b != a:
                        runs.add((min(a, b), max(a, b)))
                        break
                    b += step
        gone = set()
        for a, b in sorted(runs):
            here = (i, t, a, b)
            if seen.setdefault(tuple(w for x in s[a : b + 1] for w in x), here) != here:
                gone |= set(range(a, b + 1))
        out[i, t] = s, gone
    return out


@pytest.mark.parametrize("hot,least", [(16, 24), (2, 24), (16, 32), (16, 3)])
def test_substrings(spark, documents, monkeypatch, hot, least):
    """With and without the path for spans that many documents share; nulls and repeated rows are in."""
    monkeypatch.setattr(substrings, "HOT_HERE", hot)
    rows = documents.select("doc_id", "text").collect()
    once = sorted({(r["doc_id"], r["text"]) for r in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    want = removed_by_hand(once, least)
    got = substrings.remove(documents, least).collect()
    assert len(got) == len(rows)
    for r in got:
        s, gone = want[r["doc"]["doc_id"], r["doc"]["text"]]
        assert (r["n_sentences"], r["n_removed"]) == (len(s), len(gone))
        if not gone:
            assert r["text"] == r["doc"]["text"]
        else:
            assert words(r["text"]) == [w for k, x in enumerate(s) if k not in gone for w in x]
    assert sum(r["n_removed"] for r in got) > 30
    assert substrings.remove(documents.where("false"), least).count() == 0


def test_spans_have_several_sentences(spark):
    long = " ".join(f"w{k}" for k in range(60)) + "."
    one = " ".join(f"S{k}." for k in range(120))
    docs = spark.createDataFrame([(1, f"First here. {long} End one."), (2, f"Other here. {long} End two."), (3, one), (4, one), (5, f"Last. {long} End two.")], "doc_id long, text string")
    got = {r["doc"]["doc_id"]: r["n_removed"] for r in substrings.remove(docs).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 120, 5: 2}
    assert {r["doc"]["doc_id"]: r["n_removed"] for r in substrings.remove(docs, 32).collect()} == got
    with pytest.raises(ValueError):
        substrings.remove(docs, 50)


# ---- language ----------------------------------------------------------------------------------------------------


def test_language(spark):
    say = {"en": "the quick brown fox jumps over the lazy dog and runs through the old town with them", "fr": "le vieux renard brun saute par dessus les chiens paresseux et court dans la ville avec eux", "ru": "быстрая лиса прыгает через ленивую собаку и бежит по старому городу"}
    rows = [(k, " ".join(np.random.default_rng(k).permutation(t.split())), lang) for k in range(0, 90, 1) for lang, t in say.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(langid.sample(docs, 20))
    mixed = say["en"] + " " + say["fr"] + " " + say["ru"]
    asked = spark.createDataFrame([(1, say["en"], "x"), (2, say["fr"].upper(), "x"), (3, say["ru"], "x"), (4, None, "x"), (5, "123 !!", "x"), (6, say["en"] * 3 + say["fr"], "x"), (7, "", "x"), (1, say["en"], "x"), (8, "word " * 50_000, "x")], "doc_id long, text string, lang_pred string")
    got = langid.identify(asked, model).collect()
    assert [r["lang_pred"] for r in sorted(got, key=lambda r: r["doc"]["doc_id"])][:8] == ["en", "en", "fr", "ru", "und", "und", "en", "und"]
    assert all(0 <= r["score"] <= r["sure"] <= 1 for r in got) and len(got) == 9
    assert [s[2] for s in langid.spans(model, mixed)] == ["en", "fr", "ru"]
    assert langid.label(model, [mixed])[2][0] > 0.9 > langid.label(model, [mixed])[1][0]
    for t in (mixed, say["en"], say["ru"] + say["fr"]):  # all texts at once and one by one agree
        letters = collections.Counter()
        for a, b, lang in langid.spans(model, t):
            letters[lang] += sum(len(m) for m in langid.word_pattern().findall(t[a:b]))
        assert langid.label(model, [say["fr"], t, None])[0][1] == letters.most_common(1)[0][0]
    none = langid.fit(docs.where("false").select("text", "lang"))
    assert {r["lang_pred"] for r in langid.identify(asked, none).collect()} == {"und"}
    assert langid.identify(asked.where("false"), model).count() == 0


def test_words_are_letters_and_their_marks():
    find = langid.word_pattern().findall
    assert find("हिन्दी, ² ½ Ⅷ 12 naïve_x नुक़्ता.") == ["हिन्दी", "naïve", "x", "नुक़्ता"]
    model = langid.Model(["a"], np.zeros(0, np.int64), np.zeros((1, 1), np.float32), {})
    assert langid.label(model, ["² ½", "Ⅷ 12", "_", "é"])[0] == ["und", "und", "und", "a"]


def log_likelihoods(model, text):
    """Of each word and language, from the model's table alone."""
    out, rows = [], {int(g): k for k, g in enumerate(model.grams)}
    for word in langid.word_pattern().findall(text.lower()):
        w, allowed = f"<{word}>", model.scripts.get(langid.script(word), [True] * len(model.languages))
        s = [sum(float(model.weights[rows.get(langid.gram_number(w[i : i + 3]), -1)][k]) for i in range(len(w) - 2)) if allowed[k] else -1e9 for k in range(len(model.languages))]
        out.append((len(word), [x - max(s) for x in s]))
    return out


@pytest.mark.parametrize("languages", [3, 200])
def test_viterbi_against_all_paths(spark, languages):
    import itertools

    rng = np.random.default_rng(languages)
    grams = [a + b + c for a in "<xyz" for b in "xyz" for c in "xyz>"]
    names = [f"l{k:03}" for k in range(languages)]
    model = langid.Model(names, np.sort([langid.gram_number(g) for g in grams]), rng.normal(0, 1.5, (len(grams) + 1, languages)).astype(np.float32), {}, switch=2.0)
    texts = [" ".join("".join(rng.choice(list("xyz"), rng.integers(1, 5))) for _ in range(rng.integers(1, 7 if languages == 3 else 4))) for _ in range(40)]
    pred, score, sure = langid.label(model, texts)
    for t, p, s, u in zip(texts, pred, score, sure):
        each = log_likelihoods(model, t)
        if languages == 3:
            value = lambda path: sum(e[1][k] for e, k in zip(each, path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B023, E731
            best = max(itertools.product(range(3), repeat=len(each)), key=value)
            got = []
            for a, b, lang in langid.spans(model, t):
                got += [names.index(lang)] * len(t[a:b].split())
            assert value(got) == pytest.approx(value(best), abs=1e-4)
        else:
            got = [names.index(lang) for a, b, lang in langid.spans(model, t) for _ in t[a:b].split()]
        letters, weighed, mine, at = collections.Counter(), 0.0, collections.Counter(), 0
        for lang, run in itertools.groupby(got):
            m = len(list(run))
            total = np.array([e[1] for e in each[at : at + m]]).sum(0)
            n = sum(e[0] for e in each[at : at + m])
            posterior = 1 / np.exp(total - total[lang]).sum()
            letters[lang] += n
            mine[lang] += n * posterior
            weighed += n * posterior
            at += m
        assert letters[names.index(p)] == max(letters.values())
        assert s == pytest.approx(mine[names.index(p)] / sum(letters.values()), abs=1e-4) and u == pytest.approx(weighed / sum(letters.values()), abs=1e-4)


# ---- Jaccard -----------------------------------------------------------------------------------------------------


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    at = {i: i for i in sets}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                at[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def distinct_rows(documents):
    """(doc_id, text) once each; null ids last."""
    return sorted({(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()}, key=lambda r: (r[0] is None, r[0] or 0, str(r[1])))


@pytest.mark.parametrize("k,percent,block,wide", [(4, 85, 2048, 2048), (5, 80, 3, 4), (2, 60, 2, 1), (1, 30, 5, 3)])
def test_jaccard(documents, k, percent, block, wide, monkeypatch):
    """Nulls and repeated rows are in; shingles, groups and blocks overflow."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "ASKED", block / 2)
    monkeypatch.setattr(jaccard, "WIDE", wide)
    rows = distinct_rows(documents)
    want = brute(list(enumerate(t for _, t in rows)), k, percent)
    want = {rows[i]: (n, rows[c][0]) for i, (n, c) in want.items()}
    got = jaccard.link(documents, k, percent)
    texts = documents.select("doc_id", "text").withColumn("hash", __import__("pyspark").sql.functions.xxhash64("text")).distinct().collect()
    by_hash = {(r["doc_id"], r["hash"]): r["text"] for r in texts}
    out = got.collect()
    assert len(out) == documents.count() and sum(c != i for (i, _), (_, c) in want.items()) > 20
    for r in out:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"], by_hash[r["doc_id"], r["hash"]]]
    if block == 3:
        kept = jaccard.deduplicate(documents, k, percent)
        assert kept.columns == documents.columns
        left = [(r["doc_id"], r["text"]) for r in kept.collect()]
        groups = {c for (i, t), (n, c) in want.items() if n}
        assert sorted(i for i, t in left if words(t)) == sorted(groups, key=lambda c: (c is None, c)) if None not in groups else len([1 for i, t in left if words(t)]) == len(groups)
        assert sum(not words(t) for _, t in left) == documents.where("text is null or not text rlike '[^ \\\\t\\\\n]'").count()
        assert jaccard.link(documents.where("false"), k, percent).count() == 0


def test_deduplicate_ids_that_tell_nothing(spark):
    """Null and repeated ids: one document of each group stays, and what is linked with nothing stays."""
    say = lambda c: " ".join(f"{c}{k}" for k in range(40))
    near = lambda c: say(c) + " more"
    rows = [(None, say("a")), (1, near("a")), (None, say("clean")), (None, ""), (None, ""), (5, say("b")), (5, say("c")), (2, near("b"))]
    rows += [(7, say("d")), (7, near("d")), (None, say("e")), (None, near("e")), (9, say("f")), (9, say("f"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in jaccard.deduplicate(df).collect()), key=str)
    either = lambda i, c: next(x for x in got if x[0] == i and x[1] in (say(c), near(c)))
    want = [(1, near("a")), (None, say("clean")), (None, ""), (None, ""), (5, say("c")), (2, near("b")), either(7, "d"), either(None, "e"), (9, say("f"))]
    assert got == sorted(want, key=str)


# ---- fingerprints ------------------------------------------------------------------------------------------------


def winnow_by_hand(points, k, w):
    if len(points) < k:
        return [(0, points)] if points else []
    grams = [points[i : i + k] for i in range(len(points) - k + 1)]
    return grams


def test_winnowing_is_the_windows_rightmost_least():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 15, 16, 17, 78, 79, 80, 81, 500):
        p = rng.integers(97, 100, n).astype(np.uint32)
        kept = fingerprints.winnow(p)
        if not n:
            assert not len(kept)
            continue
        k = min(16, n)
        h = fingerprints._grams(p, k) >> np.uint64(32)
        w = min(64, len(h))
        want = set()
        for s in range(len(h) - w + 1):
            least = h[s : s + w].min()
            want.add(max(i for i in range(s, s + w) if h[i] == least))
        text = fingerprints.written(kept)
        got = [(int(text[i : i + 8], 16), int(text[i + 8 : i + 16], 16)) for i in range(0, len(text), 16)]
        assert got == [(int(h[i]), i) for i in sorted(want)]


@pytest.mark.parametrize("ids", ["unique", "many null", "one id"])
def test_next_document_over_many_ranges(spark, documents, monkeypatch, ids):
    """Ranges of a few rows, also where ids say little; nulls and repeated rows are in."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprints, "ROWS", 4)
    docs = documents.where("text is null or length(text) < 10000")
    if ids != "unique":
        docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).otherwise(F.lit(None if ids == "many null" else 50).cast("long")))
    frac = F.pmod(F.xxhash64("text"), F.lit(1 << 52)) / float(1 << 52)
    assert ids == "unique" or len({c[0] for c in fingerprints._cuts(docs)}) < len(fingerprints._cuts(docs))
    rows = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["f"], r["text"] or "") for r in docs.withColumn("f", frac).collect()))
    want = collections.Counter()
    for (none, i, _, t), (*_, nxt) in zip(rows, rows[1:] + rows[:1]):
        want[None if none else i, hashlib.sha256((t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]).encode()).hexdigest()] += 1
    got = collections.Counter((r["doc_id"], r["edited_sha256"]) for r in fingerprints.with_next(docs).collect())
    assert got == want


def test_fingerprints(documents, plain):
    got = {r["doc_id"]: r for r in fingerprints.with_next(plain).collect()}
    rows = sorted(((r["doc_id"], r["text"] or "") for r in plain.collect()))
    assert len(got) == len(rows)
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        m = len(t) // 4
        edited = t[: len(t) - m] + nxt[:m]
        r = got[i]
        a, b, c = (fingerprints.winnow(fingerprints._points(x)) for x in (t, edited, nxt))
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprints.written(a), fingerprints.written(b))
        assert r["near_edited"] == pytest.approx(fingerprints.likeness(a, b)) and r["near_next"] == pytest.approx(fingerprints.likeness(a, c))
    assert fingerprints.with_next(documents).count() == documents.count()
    one = plain.where("doc_id = 1")
    assert [r["near_next"] for r in fingerprints.with_next(one).collect()] == [1.0]
    assert fingerprints.with_next(documents.where("false")).count() == 0
    assert fingerprints.fingerprints(documents).count() == documents.count()


# ---- language model ----------------------------------------------------------------------------------------------


def brown_by_hand(model, train, texts):
    """Scores from the classes of the model alone: every other number is counted again. Texts: words and an end (None)."""
    hashes = dict(zip(model.units.hashes.tolist(), model.units.unit.tolist()))

    def unit(w):
        if w is None:
            return 0
        h, tail, _ = brown._words(__import__("pyarrow").array([w]))
        return hashes.get(int(h[0]), 1 + model.units.words + int(tail[0]))

    cls = lambda w: int(model.of[unit(w)])
    count, classes = collections.Counter(w for t in train for w in t), len(model.move)
    pairs, after = collections.Counter(), collections.Counter()
    for t in train:
        for a, b in zip([None, *t], t):
            pairs[cls(a), cls(b)] += 1
            after[cls(a)] += 1
    came, seen = collections.Counter(), collections.Counter()
    for (_, b), n in pairs.items():
        came[b] += n
    for w, n in count.items():
        seen[unit(w)] += n
    distinct = collections.Counter(unit(w) for w in count)
    mass = collections.defaultdict(float)
    for u in range(model.units.size):
        mass[int(model.of[u])] += seen[u] + 0.5
    out = []
    for t in texts:
        total = 0.0
        for a, b in zip([None, *t], t):
            p = (pairs[cls(a), cls(b)] + (came[cls(b)] + 1) / (sum(came.values()) + classes)) / (after[cls(a)] + 1)
            u = unit(b)
            if b is not None:
                p *= (seen[u] + 0.5) / mass[cls(b)]
            if u > model.units.words:
                p *= (count[b] + 1) / (seen[u] + distinct[u] + 1)
            total += math.log10(p)
        out.append(total)
    return out


@pytest.mark.parametrize("least,most", [(8, 1 << 20), (2, 60), (10**9, 1 << 20)])
def test_brown(documents, monkeypatch, least, most):
    """Nulls and repeated rows are in; all words above a count clustered, some of them, or none."""
    from pyspark.sql import functions as F

    from sedira.llm.common import Scratch, doc_crc

    monkeypatch.setattr(brown, "LEAST", least)
    monkeypatch.setattr(brown, "CLUSTERED", most)
    docs = documents.select("doc_id", "text", F.coalesce(doc_crc() % 7 == 2, F.lit(False)).alias("held_out"))
    scratch = Scratch(docs.sparkSession)
    model, table, encoded = brown.learn(docs, scratch)
    rows = brown.score(encoded, model, table, scratch).collect()
    texts = [(r["doc_id"], words(r["text"]) + [None], r["held_out"]) for r in docs.collect()]
    count = collections.Counter(w for _, t, held in texts if not held for w in t)
    n, v = sum(count.values()), len(count)
    by_hand = brown_by_hand(model, [t for _, t, held in texts if not held], [t for _, t, _ in texts])
    want = sorted((str(i), len(t), sum(count[x] > 0 for x in t), round(sum(math.log10((count[x] + 1) / (n * 1 + v + 1)) for x in t), 3), round(s, 3)) for (i, t, _), s in zip(texts, by_hand))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 3), round(r["score"], 3)) for r in rows) == want
    assert {r["train_tokens"] for r in rows} == {n}
    assert model.units.words == {8: sum(c >= 8 for w, c in count.items() if w), 2: model.units.words, 10**9: 0}[least] and model.units.words <= most
    assert np.allclose((10**model.move).sum(1), 1)
    none, table, encoded = brown.learn(docs.withColumn("held_out", F.lit(True)), scratch)
    rows = brown.score(encoded, none, table, scratch).collect()
    assert len(rows) == len(texts) and all(r["base_score"] == 0 and r["n_known"] == 0 for r in rows)
    empty, table, encoded = brown.learn(docs.where("false"), scratch)
    assert brown.score(encoded, empty, table, scratch).count() == 0


def test_parallel_exchange_finds_what_alternates(spark, monkeypatch):
    """Words of five kinds that follow each other in turn, with endings that say nothing: only the exchange of words can tell them apart."""
    from pyspark.sql import functions as F

    from sedira.llm.common import Scratch, word_hashes

    monkeypatch.setattr(brown, "HEAD", 20)
    monkeypatch.setattr(brown, "CLASSES", (6, 6))
    monkeypatch.setattr(brown, "SWEEPS", 4)
    rng = np.random.default_rng(2)
    names = [[f"{'abcde'[k]}{rng.integers(10**6)}xyz" for _ in range(60)] for k in range(5)]
    texts = [" ".join(names[(s + i) % 5][rng.integers(60)] for i in range(40)) for s in rng.integers(0, 5, 600)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("held_out", F.col("doc_id") % 10 == 0).repartition(4)
    model, table, encoded = brown.learn(docs, Scratch(spark))
    assert model.units.words == 300
    raw = np.frombuffer(" ".join(w for k in names for w in k).encode(), np.uint8)
    starts, ends, _ = brown.spans(raw, np.array([0, len(raw)]))
    unit = dict(zip(model.units.hashes.tolist(), model.units.unit.tolist()))
    got = [model.of[unit[int(h)]] for h in word_hashes(raw, starts, ends)]
    pure = sum(max(collections.Counter(got[60 * k : 60 * k + 60]).values()) for k in range(5))
    assert pure >= 285
    rows = [r for r in brown.score(encoded, model, table, Scratch(spark)).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows) + 0.5 * sum(r["n_tokens"] for r in rows)


def test_exchange_finds_what_alternates():
    rng = np.random.default_rng(0)
    size = 60
    kind = np.arange(size) % 3
    pairs = np.where((kind[:, None] + 1) % 3 == kind[None, :], rng.integers(5, 50, (size, size)), rng.integers(0, 2, (size, size))).astype(float)
    of = brown.exchange(pairs, 4, 20)
    assert len({(k, c) for k, c in zip(kind[1:], of[1:])}) == 3
