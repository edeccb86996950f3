"""Substring deduplication by sliding sentence spans.

A text is cut into sentences: after a word that ends in `.`, `!` or `?` (closing quotes and brackets may follow), and at
line breaks. From every sentence runs a span of consecutive sentences, `SENTENCES` of them or as many more as hold `words`
words, and to every sentence likewise one that ends there; every span is hashed over its words (A-Z in lower case, white space left out), all
spans are joined globally, and a sentence goes if any span that covers it occurs earlier: in a document with a smaller
doc_id, or before it in the same one. A repeated passage of several whole sentences goes as a whole if it has at least twice
`words` words, since each of its sentences then starts or ends a span within it; a single sentence that repeats between
others that do not is no span, however long.

Spans that very many documents share are found first, by counts within parts of the input; their first occurrences come from an
aggregate that combines before it exchanges, and are joined by broadcast (their number is bounded). All other spans are
exchanged once by hash and read in order, so no group is ever held.

Only . ! ? end a sentence, and only white space parts words: text of scripts that use neither is one sentence, of one word,
a line, so a passage repeated there is found only if it has twice `words` such lines.

Cases: null and empty texts have no sentence and stay as they are; rows with equal doc_id and text count as one document,
so they lose no sentence to each other; a null doc_id comes after all others; a text without sentence marks is one
sentence a line; an empty table gives no rows. `remove` keeps other columns in a struct, so that no name clashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedira.llm.common import Scratch, _powers, gathered, lean, mix, most_frequent, parts, read, slices, spans, text_buffers, word_hashes

#: Words of a span at least, and sentences; a row of the exchange has room for `MOST` sentences of a span.
WORDS, SENTENCES, MOST = 24, 2, 32
#: A span found `HOT_HERE` times in a few million counts as hot; the list has at most `HOT_MOST` entries (under 4 MB).
HOT_HERE, HOT_MOST = 16, 1 << 17
_AFTER = np.zeros(256, bool)
_AFTER[list(b"\"')]}")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_NO_ID = (1 << 63) - 1


class Sentences:
    """The sentences of a slice of texts: byte starts, word ranges and, for each document, the range of its sentences."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = text_buffers(texts)
        self.starts, self.ends, self.words_at = spans(self.data, self.offsets)
        n = len(self.starts)
        last = self.ends - 1
        for _ in range(3):  # closing marks after the stop
            skip = _AFTER[self.data[last]] & (last > self.starts) if n else np.zeros(0, bool)
            last = np.where(skip, last - 1, last)
        stop = _STOP[self.data[last]] if n else np.zeros(0, bool)
        lines = np.concatenate([[0], np.cumsum(self.data == 10)])
        if n:
            stop[:-1] |= lines[self.starts[1:]] > lines[self.ends[:-1]]
            stop[-1] = True
            closing = self.words_at[1:] - 1
            stop[closing[(np.diff(self.words_at) > 0)]] = True
        self.to = np.flatnonzero(stop) + 1  # words
        self.at = np.concatenate([[0], self.to[:-1]]) if len(self.to) else self.to
        self.of_doc = np.searchsorted(self.at, self.words_at)  # where each document's sentences start

    def runs(self, words: int, sentences: int = SENTENCES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, document, first and last sentence of each span."""
        if not len(self.at):
            return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
        m = len(self.at)
        doc = np.repeat(np.arange(len(self.of_doc) - 1), np.diff(self.of_doc))
        s = np.arange(m)
        e = np.maximum(np.searchsorted(self.to, self.at + words), s + sentences - 1)
        ok = (e < m) & (doc[np.minimum(e, m - 1)] == doc)
        back = np.minimum(np.searchsorted(self.at, self.to - words, "right") - 1, s - sentences + 1)
        ok_back = (back >= 0) & (doc[np.maximum(back, 0)] == doc)
        ok_back &= e[np.maximum(back, 0)] != s  # else it is a span from there already
        first, last = np.concatenate([s[ok], back[ok_back]]), np.concatenate([e[ok], s[ok_back]])
        h = word_hashes(self.data, self.starts, self.ends)
        power, inverse = _powers(len(h) + 1)
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * power[: len(h)], out=sums[1:])
        a, b = self.at[first], self.to[last]
        return mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64)), doc[first], first, last


def _rows(docs: DataFrame, words: int, hot, keep_hot: bool) -> DataFrame:
    """(h, doc_id, at): at is 32 bits of the text's hash, 27 of the first sentence's number and 5 of the span's sentences less one (each has a word, so `words` bounds them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                x = Sentences(b.column("text"))
                h, doc, first, last = x.runs(words)
                if hot is not None and len(hot.value):
                    i = np.minimum(np.searchsorted(hot.value, h), len(hot.value) - 1)
                    sel = (hot.value[i] == h) == keep_hot
                    h, doc, first, last = h[sel], doc[sel], first[sel], last[sel]
                elif keep_hot:
                    continue
                th = b.column("th").to_numpy()[doc]
                at = (th << 32) | ((first - x.of_doc[doc]) << 5) | (last - first)
                ids = b.column("doc_id").to_numpy(zero_copy_only=False)[doc]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids.astype(np.int64)), pa.array(at.astype(np.int64))], ["h", "doc_id", "at"])

    return docs.mapInArrow(lean(run), "h long, doc_id long, at long")


def _hot(docs: DataFrame, words: int) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h in gathered(Sentences(b.column("text")).runs(words)[0] for whole in batches for b in slices(whole)):
            h, n = np.unique(h, return_counts=True)
            n, h = n[n >= HOT_HERE], h[n >= HOT_HERE]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    found = docs.mapInArrow(lean(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = most_frequent(Scratch(docs.sparkSession).keep(found, "hot"), "n", HOT_MOST)
    return np.sort(top["h"].astype(np.int64).view(np.uint64))


def repeats(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, at) of every span that is not the first of its kind; `docs` has doc_id (no null), text and th."""
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast(_hot(docs, words))

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            if not b.num_rows:
                continue
            h, ids, at = (b.column(c).to_numpy() for c in ("h", "doc_id", "at"))
            again = np.zeros(len(h), bool)
            again[1:] = h[1:] == h[:-1]
            # the very same place of a repeated row follows the first one directly, and is no later occurrence
            key = None
            if before is not None and h[0] == before[0]:
                again[0] = True
                key = before[1:]
            start = np.flatnonzero(~again)
            group = np.searchsorted(start, np.arange(len(h)), "right") - 1
            if len(start):
                fi, fa = ids[start[np.maximum(group, 0)]], at[start[np.maximum(group, 0)]]
            else:
                fi, fa = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
            if key is not None:
                own = group < 0
                fi, fa = np.where(own, key[0], fi), np.where(own, key[1], fa)
            again &= (ids != fi) | (at != fa)
            before = (h[-1], fi[-1], fa[-1])
            yield pa.RecordBatch.from_arrays([pa.array(ids[again]), pa.array(at[again])], ["doc_id", "at"])

    rare = _rows(docs, words, hot, False).repartition(parts(spark), "h").sortWithinPartitions("h", "doc_id", "at").mapInArrow(lean(later), "doc_id long, at long")
    if not len(hot.value):
        return rare
    common = _rows(docs, words, hot, True)
    first = common.groupBy("h").agg(F.min(F.struct("doc_id", "at")).alias("first"))  # HOT_MOST rows at most
    common = common.join(F.broadcast(first), "h").where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("at") != F.col("first.at"))).select("doc_id", "at")
    return rare.unionByName(common)


def remove(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """`words`: at most `MOST`. doc (struct of the input's columns), text (without the removed sentences), n_sentences, n_removed, removed (array of struct start, end: byte spans of the removed sentences in the input's text)."""
    if not 1 <= words <= MOST:  # each sentence has a word, so `words` bounds the sentences of a span
        raise ValueError(f"a span of {words} words; 1 to {MOST} are possible")
    th = F.xxhash64(F.col("text")).bitwiseAND(F.lit(0x7FFFFFFF))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"), th.alias("th"))
    found = repeats(keyed, words)
    marks = found.withColumn("th", F.shiftrightunsigned("at", 32)).groupBy("doc_id", "th").agg(F.collect_set(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))).alias("marks"))
    rows = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_id"), th.alias("_th"))
    joined = rows.join(marks.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "marks"), ["_id", "_th"], "left").select("doc", "marks")
    kind = joined.schema["doc"].dataType
    text = next(k for k, f in enumerate(kind.fields) if f.name.lower() == "text")
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc = b.column("doc")
            out = list(zip(*(_cut(t, m) for t, m in zip(pc.struct_field(doc, text).cast(pa.string()).to_pylist(), b.column("marks").to_pylist())))) or [()] * 4
            cols = [doc, *(pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), spans_type)))]
            yield pa.RecordBatch.from_arrays(cols, ["doc", "text", "n_sentences", "n_removed", "removed"])

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    fields = [("doc", kind), ("text", T.StringType()), ("n_sentences", T.LongType()), ("n_removed", T.LongType()), ("removed", T.ArrayType(span))]
    return joined.mapInArrow(lean(cut), T.StructType([T.StructField(n, t) for n, t in fields]))


def _cut(text: str | None, marks) -> tuple:
    if text is None:
        return None, 0, 0, []
    x = Sentences(pa.array([text]))
    n = len(x.at)
    if marks is None or not len(marks):
        return text, n, 0, []
    gone = np.zeros(n, bool)
    for m in marks:
        s, more = int(m) >> 5, int(m) & 31
        gone[s : s + more + 1] = True
    starts = np.concatenate([x.starts[x.at], [len(x.data)]])
    raw = x.data.tobytes()
    kept = raw[: starts[0]] + b"".join(raw[starts[k] : starts[k + 1]] for k in np.flatnonzero(~gone))
    return kept.decode(), n, int(gone.sum()), [{"start": int(starts[k]), "end": int(starts[k + 1])} for k in np.flatnonzero(gone)]


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", spread=True).select("doc_id", "text")
    return remove(docs).select("doc.doc_id", "n_sentences", "n_removed", F.size("removed").alias("n_spans"), "text")
