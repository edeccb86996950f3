"""Language-model scoring by a class-based bigram model (after Brown).

Words are units: every word that occurs `LEAST` times in training by itself (`CLUSTERED` of them at most, the most frequent
ones), and the rarer ones by their last bytes, hashed to `TAILS` tails, as a handful of neighbours says little of a word.

The exchange algorithm assigns units to classes so that the likelihood of class bigrams grows, in two steps. First the
`HEAD` most frequent words and the tails of all others are exchanged one by one in the driver, over their bigrams, each to
the class where it gains most, until a turn moves little. From these classes, all units are exchanged in parallel: for each
unit the classes to its left and right are counted over the whole corpus, exchanged by unit, and each task moves its units,
the most frequent first, to the classes where they gain most, on a copy of the table of class bigrams that it keeps up to
date; then classes and table are taken anew, `SWEEPS` times or until units of few tokens move.

A text's probability is the product, over its words and its end, of P(class | class before) and P(unit | class), and for a
word of a tail of P(word | tail) = (c + 1) / (N + V + 1) over the tail's tokens and distinct words, so every word has a
probability. Transitions are smoothed towards the classes' own distribution.

All counts are over all training documents. Word counts are exchanged by word (combined per task first). Texts are encoded as
units once, and all later steps read that table. The units (8 bytes a word, 8 MB at most) are broadcast and their classes
fetched; for the words of tails, the counts are joined.

Words are told apart by 64-bit hashes. Cases: null and empty texts have one token, the end; a null doc_id is of the
training part; repeated rows are scored alike and counted as often as they occur; a corpus without training documents
gives every text a score of uniform classes and a base of 0; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedira.llm.common import bounds, doc_crc, fetch, gathered, lean, most_frequent, packed_lists, parts, read, Scratch, slices, spans, text_buffers, word_hashes

#: Occurrences of a word that is clustered by itself; such words at most (a broadcast of 8 MB of hashes, and as much of their classes).
LEAST, CLUSTERED = 8, 1 << 20
#: Words and tails that the driver exchanges; turns of the driver and of the tasks at most; classes at least and at most (else the cube root of the words).
HEAD, TAILS, TURNS, SWEEPS, CLASSES = 447, 576, 8, 2, (16, 96)
#: A unit of so many neighbours is moved by its exact gain, one by one; others by the slope of the gain, `TOGETHER` at a time.
EXACT, TOGETHER = 4096, 256
#: Tokens whose neighbours a task counts before it gives the counts away.
CHUNK = 1 << 21
_END = 0
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[0x41:0x5B] += 0x20


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and tail (0 to TAILS - 1) of each word, and where each document's words start."""
    data, offsets = text_buffers(texts)
    starts, ends, at = spans(data, offsets)
    h = word_hashes(data, starts, ends)
    code = np.zeros(len(ends), np.uint32)
    for k in range(3):
        i = ends - 1 - k
        code |= np.where(i >= starts, _FOLD[data[np.maximum(i, 0)]] if len(data) else 0, 0).astype(np.uint32) << np.uint32(8 * k)
    tail = (code * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(TAILS)
    return h, tail.astype(np.int64), at


def vocabulary(training: DataFrame) -> DataFrame:
    """(h, tail, c): the count of every word."""

    def both(b: pa.RecordBatch) -> np.ndarray:
        h, tail, _ = _words(b.column("text"))
        return np.stack([h.view(np.int64), tail], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in gathered((both(b) for whole in batches for b in slices(whole)), 2 << 20):
            h, first, c = np.unique(x[:, 0], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(x[first, 1].astype(np.int16)), pa.array(c.astype(np.int64))], ["h", "tail", "c"])

    return training.select("text").mapInArrow(lean(run), "h long, tail short, c long").groupBy("h").agg(F.first("tail").alias("tail"), F.sum("c").alias("c"))


@dataclass
class Units:
    """0 is the end, 1 to `words` are the clustered words by falling count, then come the tails."""

    hashes: np.ndarray  # of the words, sorted
    unit: np.ndarray  # of each of `hashes`
    tail: np.ndarray  # tail of each word, by unit less 1
    count: np.ndarray  # of each word, by unit less 1

    @property
    def words(self) -> int:
        return len(self.hashes)

    @property
    def size(self) -> int:
        return 1 + self.words + TAILS

    def of(self, h: np.ndarray, tail: np.ndarray) -> np.ndarray:
        if not self.words:
            return 1 + tail
        i = np.minimum(np.searchsorted(self.hashes, h), self.words - 1)
        return np.where(self.hashes[i] == h, self.unit[i], 1 + self.words + tail)

    def seeds(self) -> np.ndarray:
        """Of each unit, its number among the end, the HEAD first words and the tails, which stand for all other words."""
        n = min(HEAD, self.words)
        return np.concatenate([np.arange(1 + n), 1 + n + self.tail[n:], 1 + n + np.arange(TAILS)])


def units(words: DataFrame) -> Units:
    """`words`: a written table."""
    top = most_frequent(words.where(F.col("c") >= LEAST), "c", CLUSTERED)
    order = np.lexsort((top["h"], -top["c"]))
    h, tail, c = top["h"][order].astype(np.int64).view(np.uint64), top["tail"][order].astype(np.int64), top["c"][order].astype(np.int64)
    by = np.argsort(h)
    return Units(h[by], (1 + by).astype(np.int32), tail, c)


def encode(docs: DataFrame, shared) -> DataFrame:
    """row, doc_id, held_out, ids (32-bit units of the words) and rest (64-bit hashes of those that are units of tails), one row a document; shared: a broadcast of the units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u: Units = shared.value
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for b in slices(whole):
                h, tail, at = _words(b.column("text"))
                x = u.of(h, tail)
                rare = np.concatenate([[0], np.cumsum(x > u.words)])[at]
                ids, rest = x.astype(np.int32).tobytes(), h[x > u.words].tobytes()
                cols = [np.arange(row, row + b.num_rows), b.column("doc_id"), b.column("held_out")]
                cols += [pa.array([raw[w * s : w * e] for s, e in zip(a[:-1], a[1:])], pa.binary()) for raw, w, a in ((ids, 4, at.tolist()), (rest, 8, rare.tolist()))]
                row += b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], ["row", "doc_id", "held_out", "ids", "rest"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(lean(run), "row long, doc_id long, held_out boolean, ids binary, rest binary")


def _chain(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The units of all documents with the end before the first and after each, and the number of words of each document."""
    n = np.array([len(i) // 4 for i in ids], np.int64)
    u = np.frombuffer(b"".join(ids), np.int32)
    out = np.full(len(u) + len(n) + 1, _END, np.int32)
    out[np.arange(len(u)) + np.repeat(np.arange(len(n)), n) + 1] = u
    return out, n


def _chains(batches: Iterator[pa.RecordBatch], at_least: int) -> Iterator[np.ndarray]:
    """Chains of some documents, of about so many tokens."""
    held: list[bytes] = []
    size = 0
    for b in batches:
        for i in b.column("ids").to_pylist():
            held.append(i)
            size += len(i) // 4 + 1
            if size >= at_least:
                yield _chain(held)[0]
                held, size = [], 0
    if held:
        yield _chain(held)[0]


def bigrams(encoded: DataFrame, of: np.ndarray, size: int) -> np.ndarray:
    """Counts of neighbouring kinds of units: `of` gives the kind of each unit, `size` bounds them (1 + HEAD + TAILS at most). Each task adds up its own, so the exchange has size**2 rows a task at most."""
    shared = encoded.sparkSession.sparkContext.broadcast(of.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kind = np.zeros(size * size, np.int64), shared.value
        for chain in _chains(batches, CHUNK):
            x = kind[chain].astype(np.int64)
            total += np.bincount(x[:-1] * size + x[1:], minlength=size * size)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["pair", "c"])

    got = fetch(encoded.select("ids").mapInArrow(lean(run), "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")))
    out = np.zeros(size * size)
    out[got["pair"]] = got["c"]
    return out.reshape(size, size)


def _f(x: np.ndarray) -> np.ndarray:
    """x log x of counts: 0 and 1 give 0."""
    return x * np.log(np.maximum(x, 1.0))


def _gains(k: np.ndarray, o: np.ndarray, i: np.ndarray, own: float = 0.0) -> np.ndarray:
    """By how much the log likelihood of class bigrams `k`, which lack a unit, grows if the unit joins each class; o, i: classes that follow and precede it, own: how often it follows itself. Class 0 is the end's alone."""
    fk, d = _f(k), np.arange(len(k))
    row, col = _f(k + o[None, :]) - fk, _f(k + i[:, None]) - fk
    gain = row.sum(1) - row[d, d] + col.sum(0) - col[d, d] + _f(k[d, d] + o + i + own) - fk[d, d]
    rows, cols = k.sum(1), k.sum(0)
    gain -= _f(rows + o.sum() + own) - _f(rows) + _f(cols + i.sum() + own) - _f(cols)
    gain[_END] = -np.inf
    return gain


def exchange(pairs: np.ndarray, classes: int, turns: int = TURNS) -> np.ndarray:
    """The class of each unit; the end has class 0 to itself."""
    size = len(pairs)
    weight = pairs.sum(1) + pairs.sum(0)
    order = [u for u in np.argsort(-weight, kind="stable") if u != _END and weight[u]]
    of = np.full(size, 1)
    of[_END] = 0
    of[order] = 1 + np.arange(len(order)) % (classes - 1)
    member = np.zeros((size, classes))
    member[np.arange(size), of] = 1
    out, in_ = pairs @ member, pairs.T @ member
    k = member.T @ out
    for _ in range(turns):
        moved = 0
        for u in order:
            a, own = of[u], pairs[u, u]
            o, i = out[u].copy(), in_[u].copy()
            o[a] -= own
            i[a] -= own
            k[a] -= o
            k[:, a] -= i
            k[a, a] -= own
            gain = _gains(k, o, i, own)
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            k[b] += o
            k[:, b] += i
            k[b, b] += own
            if b != a:
                moved += 1
                of[u] = b
                out[:, a] -= pairs[:, u]
                out[:, b] += pairs[:, u]
                in_[:, a] -= pairs[u]
                in_[:, b] += pairs[u]
        if moved <= len(order) // 200:
            break
    return of


def _move(k: np.ndarray, before: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Classes of units after an exchange; x: rows of counts of the classes before and after each unit. `k` is kept up to date."""
    C = len(k)
    after = before.copy()
    weight = x.sum(1)
    order = np.argsort(-weight, kind="stable")
    many = order[weight[order] >= EXACT]
    for u in many:
        a, i, o = before[u], x[u, :C], x[u, C:]
        k[a] -= o
        k[:, a] -= i
        np.maximum(k, 0, out=k)
        gain = _gains(k, o, i)
        b = int(gain.argmax())
        after[u] = b = b if gain[b] > gain[a] + 1e-9 else a
        k[b] += o
        k[:, b] += i
    few = order[weight[order] < EXACT]
    for at in range(0, len(few), TOGETHER):
        u = few[at : at + TOGETHER]
        a, i, o = before[u], x[u, :C], x[u, C:]
        rows, cols = k.sum(1), k.sum(0)
        logs = np.log(k + 0.5)
        score = o @ (logs - np.log(rows + 0.5 * C)[:, None]).T + i @ (logs - np.log(cols + 0.5 * C)[None, :])
        # a unit's own class is judged without the unit
        left = np.maximum(k[a] - o, 0) + 0.5, np.maximum(k[:, a].T - i, 0) + 0.5
        own = (o * np.log(left[0])).sum(1) - o.sum(1) * np.log(np.maximum(rows[a] - o.sum(1), 0) + 0.5 * C) + (i * np.log(left[1])).sum(1) - i.sum(1) * np.log(np.maximum(cols[a] - i.sum(1), 0) + 0.5 * C)
        score[np.arange(len(u)), a] = own
        score[:, _END] = -np.inf
        b = score.argmax(1)
        b = np.where(score[np.arange(len(u)), b] > own + 1e-9, b, a)
        after[u] = b
        far = np.flatnonzero(a != b)
        for sign, c in ((-1, a), (1, b)):
            np.add.at(k, c[far], sign * o[far])
            np.add.at(k.T, c[far], sign * i[far])
        np.maximum(k, 0, out=k)
    return after


def sweep(encoded: DataFrame, of: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The classes of all units after a parallel exchange; of: their classes before, k: the counts of class bigrams."""
    spark = encoded.sparkSession
    C, n_parts = len(k), parts(spark)
    shared = spark.sparkContext.broadcast((of.astype(np.int16), k))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value[0]
        for chain in _chains(batches, CHUNK):
            c, u = classes[chain].astype(np.int64), chain.astype(np.int64) * (2 * C)
            x = np.concatenate([u[1:] + c[:-1], u[:-1] + c[1:] + C])
            x.sort()
            at = bounds(x)
            key = x[at[:-1]]
            unit, slot, n = key // (2 * C), (key % (2 * C)).astype(np.uint8), np.diff(at).astype(np.uint32)
            ok = np.searchsorted(unit, 1)  # not the end
            yield pa.RecordBatch.from_arrays(packed_lists(unit[ok:], slot[ok:], n[ok:]), ["unit", "slots", "counts"])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, table = shared.value[0], shared.value[1].copy()
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

        def done(unit, slot, n) -> pa.RecordBatch:
            at = bounds(unit)
            own = unit[at[:-1]] if len(unit) else unit
            row = np.repeat(np.arange(len(own)), np.diff(at))
            x = np.bincount(row * (2 * C) + slot, n, len(own) * 2 * C).reshape(len(own), 2 * C)
            after = _move(table, classes[own].astype(np.int64), x)
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array(after.astype(np.int16)), pa.array(x.sum(1).astype(np.int64))], ["unit", "cls", "n"])

        for b in batches:
            if not b.num_rows:
                continue
            slots = b.column("slots").to_pylist()
            unit = np.repeat(b.column("unit").to_numpy(), [len(s) for s in slots])
            new = unit, np.frombuffer(b"".join(slots), np.uint8).astype(np.int64), np.frombuffer(b"".join(b.column("counts").to_pylist()), np.uint32).astype(float)
            unit, slot, n = (np.concatenate(p) for p in zip(held, new))
            cut = int(np.searchsorted(unit, unit[-1]))  # the last unit's rows may go on in the next batch
            if cut:
                yield done(unit[:cut], slot[:cut], n[:cut])
            held = unit[cut:], slot[cut:], n[cut:]
        if len(held[0]):
            yield done(*held)

    rows = encoded.select("ids").mapInArrow(lean(count), "unit long, slots binary, counts binary")
    rows = rows.repartition(n_parts, "unit").sortWithinPartitions("unit")
    got = fetch(rows.mapInArrow(lean(move), "unit long, cls short, n long"))
    out = of.copy()
    out[got["unit"]] = got["cls"]
    return out


@dataclass
class Model:
    units: Units
    of: np.ndarray  # class of each unit
    move: np.ndarray  # log10 P(class | class before)
    emit: np.ndarray  # log10 P(unit | class); of a tail, less log10 of its N + V + 1
    n: int  # training tokens
    v: int  # distinct ones
    ends: int  # of the tokens, ends


def learn(docs: DataFrame, scratch: Scratch) -> tuple[Model, DataFrame, DataFrame]:
    """The model of those of `docs` (doc_id, text, held_out) that are not held out, the written table of all words, and that of all encoded documents."""
    spark = docs.sparkSession
    training = docs.where(~F.col("held_out"))
    words = scratch.keep(vocabulary(training), "words")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    u = units(words)
    every = scratch.keep(encode(docs, spark.sparkContext.broadcast(u)), "encoded", "zstd")
    encoded = every.where(~F.col("held_out"))
    ends = encoded.count()
    seeds = u.seeds()
    pairs = bigrams(encoded, seeds, int(seeds.max()) + 1)
    classes = int(np.clip(round(u.words ** (1 / 3)), *CLASSES))
    of_seed = exchange(pairs, classes)
    of = of_seed[seeds]
    member = np.zeros((len(of_seed), classes))
    member[np.arange(len(of_seed)), of_seed] = 1
    k = member.T @ pairs @ member
    seen = np.concatenate([[ends], u.count, np.zeros(TAILS)])
    by_tail = {r["tail"]: (r["n"], r["v"]) for r in words.groupBy("tail").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}  # TAILS rows at most
    n_tail, v_tail = (np.array([by_tail.get(t, (0, 0))[j] for t in range(TAILS)], float) for j in (0, 1))
    n_tail -= np.bincount(u.tail, u.count, TAILS)
    v_tail -= np.bincount(u.tail, minlength=TAILS)
    seen[1 + u.words :] = n_tail
    for _ in range(SWEEPS if ends else 0):
        moved = sweep(encoded, of, k)
        share = seen[moved != of].sum() / seen.sum()
        of = moved
        k = bigrams(encoded, of, classes)
        if share < 0.005:
            break
    own = (k.sum(0) + 1) / (k.sum() + classes)
    move = np.log10((k + own[None, :]) / (k.sum(1)[:, None] + 1))
    emit = np.log10((seen + 0.5) / np.bincount(of, seen + 0.5, classes)[of])
    emit[_END] = 0.0
    emit[1 + u.words :] -= np.log10(n_tail + v_tail + 1)
    return Model(u, of, move, emit, int(total["n"]) + ends, int(total["v"]) + (ends > 0), ends), words, every


def score(encoded: DataFrame, model: Model, words: DataFrame, scratch: Scratch, name: str = "partial") -> DataFrame:
    """Encoded documents with n_tokens, n_known, train_tokens, base_score and score, one row a document."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        log_c = np.concatenate([[np.log10(m.ends + 1.0)], np.log10(m.units.count + 1.0), np.zeros(TAILS)])
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                x, n = _chain(part.column("ids").to_pylist())
                c, x = m.of[x], x[1:]
                doc = np.repeat(np.arange(len(n)), n + 1)
                add = lambda w: np.bincount(doc, w, len(n))  # noqa: B023, E731
                known = add(((x > _END) & (x <= m.units.words)).astype(float)).astype(np.int64) + (m.ends > 0)
                cols = [part.column("row"), part.column("doc_id"), part.column("held_out"), n + 1, known, add(log_c[x]), add(m.move[c[:-1], c[1:]] + m.emit[x])]
                yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in cols], ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    part = encoded.select("row", "doc_id", "held_out", "ids").mapInArrow(lean(run), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("rest").to_pylist()
            h = np.frombuffer(b"".join(raw), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.repeat(b.column("row").to_numpy(), [len(r) // 8 for r in raw]))], ["h", "row"])

    more = encoded.select("row", "rest").mapInArrow(lean(unpack), "h long, row long").join(words.select("h", F.log10(F.col("c") + 1).alias("log_c")), "h")
    more = more.groupBy("row").agg(F.sum("log_c").alias("more"), F.count(F.lit(1)).alias("found"))
    whole = float(np.log10(model.n + model.v + 1))
    more_c, found = F.coalesce("more", F.lit(0.0)), F.coalesce("found", F.lit(0))
    return part.join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + found).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + more_c - F.col("n_tokens") * F.lit(whole)).alias("base_score"), (F.col("score") + more_c).alias("score"),
    )


def perplexity(score: Column, tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -score / tokens)


def op10_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", spread=True).select("doc_id", "text", F.coalesce(doc_crc() % 7 == 2, F.lit(False)).alias("held_out"))
    scratch = Scratch(spark)
    model, words, encoded = learn(docs, scratch)
    return score(encoded, model, words, scratch).withColumn("perplexity", perplexity(F.col("score"), F.col("n_tokens")))
