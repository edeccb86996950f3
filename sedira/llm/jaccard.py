"""N-gram Jaccard join by a token-group matrix.

1. Every document becomes the set of its hashed word shingles; documents with equal sets are one class from there on.
2. Similar documents are partitioned into groups: classes that share one of two least-hash shingles are compared within
   that share; what is linked so is one group, and what is not stays grouped by the first of the two. (Which documents
   meet in a group says how much is left to do, not what is found.)
3. The matrix holds, for each group, the union of its members' prefix shingles. In any common order of the shingles, sets
   x and y with Jaccard similarity t share at least a - ceil(t n) + 1 of the first n - ceil(t n) + 1 shingles of each, with
   a the overlap they need and n the size of the one whose prefix ends first. So the number of shingles that two groups'
   unions share bounds what any of their members can have in common, and only pairs of groups that reach the bound
   qualify. The order puts shingles that many documents hold last, and of these the most frequent ones, so that a
   passage of many documents brings few candidates. Any order is exact; what counts as frequent only says how many groups
   are opened.
4. Qualifying groups are opened: the members of the smaller one are held against all members of the other, exactly.
   Members are dealt out in blocks, and the queries of a block in parts, so no group has to fit into one task and no
   group that many others are held against keeps one busy; no pairs within a group are listed.
5. Links are contracted to connected components, distributed.

Shingles are 64-bit hashes (63 bits used, 57 of frequent ones); classes are told apart by 64 bits over the whole set.

Cases: null and empty texts, and texts of white space, have the empty set and link with nothing, not even each other; a
text of fewer than k words is one shingle; repeated rows and copies are one class; a null doc_id counts as larger than
every other, and a group of only such has component_id null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedira.llm.common import bounds, components, gathered, lean, mix, most_frequent, parts, read, Scratch, shingle_hashes, slices, spans, text_buffers, whole_groups, word_hashes

#: A shingle that `FREQUENT` documents hold, as counted within a few million shingles at a time, is put last in the order; the list has at most `FREQUENT_MOST` entries (2 MB).
FREQUENT, FREQUENT_MOST = 12, 1 << 18
#: Members of a group that one task opens at a time; shingles of them, as a mean, that it holds (8 bytes each); hits it counts at once.
BLOCK, BLOCK_SHINGLES, HITS = 2048, 1 << 21, 1 << 20
#: Queries of other groups that one task holds against a block, as a mean; the block is repeated for every so many.
ASKED = 4096
#: Groups of a shingle that one task pairs with each other; blocks of more groups at most (each group is repeated for every block).
WIDE, BLOCKS = 2048, 16
#: Rows (two numbers each) of a table that is broadcast at most; beyond it the optimizer chooses the join.
BROADCAST = 1 << 20
_HALF = np.uint64(1)
_LAST = np.uint64(1 << 63)
_S1 = np.uint64(0xD6E8FEB86659FD93)
_SEEDS = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def _sets(batch: pa.RecordBatch, k: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles (frequent ones last, under other numbers: `frequent` has both) of the documents of a batch, and where each document's start."""
    data, offsets = text_buffers(batch.column("text"))
    starts, ends, at = spans(data, offsets)
    h, to = shingle_hashes(word_hashes(data, starts, ends), at, k)
    h >>= _HALF
    if frequent.shape[1]:
        i = np.minimum(np.searchsorted(frequent[0], h), frequent.shape[1] - 1)
        h = np.where(frequent[0][i] == h, frequent[1][i], h)
    for d in range(len(to) - 1):
        h[to[d] : to[d + 1]].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[to[:-1][to[:-1] < len(h)]] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[to]


def _frequent(docs: DataFrame, k: int, scratch: Scratch) -> np.ndarray:
    """Hashes of frequent shingles, sorted, and under them the numbers that put them last, by half powers of two of their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h in gathered(_sets(b, k, np.zeros((2, 0), np.uint64))[0] for whole in batches for b in slices(whole)):
            h, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["h", "n"])

    found = docs.select("text").mapInArrow(lean(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    top = most_frequent(scratch.keep(found, "frequent"), "n", FREQUENT_MOST)
    h = top["h"].astype(np.int64).view(np.uint64)
    many = np.minimum(2 * np.log2(np.maximum(top["n"].astype(float), 1.0)), 63).astype(np.uint64)
    last = _LAST | many << np.uint64(57) | h & np.uint64((1 << 57) - 1)
    return np.stack([h, last])[:, np.argsort(h)]


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def signatures(docs: DataFrame, k: int, percent: int, frequent) -> DataFrame:
    """doc_id, hash (of the text), n (set size), cls (hash of the set), key0 and key1 (least-hash shingles), prefix (bytes); frequent: a broadcast of the frequent shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                h, to = _sets(b, k, frequent.value)
                n = np.diff(to)
                full = np.flatnonzero(n)
                keys = [np.zeros(len(n), np.uint64) for _ in _SEEDS]
                if len(full):
                    for key, seed in zip(keys, _SEEDS):
                        key[full] = np.minimum.reduceat(mix(h ^ seed), to[:-1][full])
                keep = np.where(n > 0, n - _needed(n, percent) + 1, 0)
                prefix = [h[a : a + p].tobytes() for a, p in zip(to[:-1], keep)]
                cols = [b.column("doc_id"), b.column("hash"), n.astype(np.int64), _classes(h, to).view(np.int64), *(key.view(np.int64) for key in keys), pa.array(prefix, pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], ["doc_id", "hash", "n", "cls", "key0", "key1", "prefix"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).mapInArrow(lean(run), "doc_id long, hash long, n long, cls long, key0 long, key1 long, prefix binary")


def _classes(h: np.ndarray, to: np.ndarray) -> np.ndarray:
    n = np.diff(to)
    full = np.flatnonzero(n)
    out = np.zeros(len(n), np.uint64)
    if len(full):
        out[full] = mix(np.add.reduceat(mix(h * _S1), to[:-1][full]) + n[full].astype(np.uint64))
    return out


def matrix(rows: DataFrame) -> DataFrame:
    """The token-group matrix: (token, gid, nmin, nmax, place): sizes of the members with the token in their prefix, and its least place there. Rows (gid, n, prefix) of one group are merged, a million shingles at a time, before they are exchanged."""

    def unpacked(b: pa.RecordBatch) -> np.ndarray:
        raw = b.column("prefix").to_pylist()
        tokens = np.frombuffer(b"".join(raw), np.int64)
        per = np.array([len(r) // 8 for r in raw])
        row = np.repeat(np.arange(len(raw)), per)
        place = np.arange(len(tokens)) - np.repeat(np.cumsum(per) - per, per)
        return np.stack([tokens, b.column("gid").to_numpy()[row], b.column("n").to_numpy()[row], place], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in gathered((unpacked(b) for b in batches if b.num_rows), 1 << 20):
            yield _merged(x[:, 0], x[:, 1], x[:, 2], x[:, 2], x[:, 3])

    return rows.select("gid", "n", "prefix").mapInArrow(lean(run), "token long, gid long, nmin long, nmax long, place long")


def _merged(token, gid, nmin, nmax, place) -> pa.RecordBatch:
    order = np.lexsort((gid, token))
    token, gid = token[order], gid[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (gid[1:] != gid[:-1])
    at = np.flatnonzero(new)
    lo, hi, first = ((f.reduceat(x[order], at) if len(at) else x[:0]) for f, x in ((np.minimum, nmin), (np.maximum, nmax), (np.minimum, place)))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (token[at], gid[at], lo, hi, first)], ["token", "gid", "nmin", "nmax", "place"])


def _summed(x: np.ndarray) -> np.ndarray:
    """Rows a, b, shared, least and most size of a's and b's; those of a pair are made one."""
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    at = np.flatnonzero(np.concatenate([[True], (x[1:, :2] != x[:-1, :2]).any(1)])) if len(x) else np.zeros(0, np.int64)
    if not len(at):
        return x
    return np.concatenate([x[at, :2], np.add.reduceat(x[:, 2:3], at), np.minimum.reduceat(x[:, [3, 5]], at), np.maximum.reduceat(x[:, [4, 6]], at)], 1)[:, [0, 1, 2, 3, 5, 4, 6]]


_PAIR = ["a", "b", "shared", "la", "ha", "lb", "hb"]


def _pair_batch(x: np.ndarray, tile: bool) -> pa.RecordBatch:
    """Pairs, or (tile) rows of tiles to come: gid, own block, same block twice, least and most size, tile, 0."""
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T.copy()), pa.array(np.full(len(x), tile))], [*_PAIR, "deferred"])


def _paired(keys: np.ndarray, gid, lo, hi, percent: int, own: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Pairs of groups with the same key (sorted) whose members' sizes can be similar, not yet summed; with `own`, only of different blocks. The d-th next row of the same key, for all keys at once: as many turns as the longest run has rows."""
    at = bounds(keys)
    size = np.diff(at)
    for d in range(1, int(size.max(initial=1))):
        long = np.flatnonzero(size > d)
        i = _ranges(at[long], size[long] - d)
        j = i + d
        ok = (100 * hi[j] >= percent * lo[i]) & (100 * hi[i] >= percent * lo[j])
        if own is not None:
            ok &= own[i] != own[j]
        i, j = i[ok], j[ok]
        swap = gid[i] > gid[j]
        i, j = np.where(swap, j, i), np.where(swap, i, j)
        yield np.stack([gid[i], gid[j], np.ones(len(i), np.int64), lo[i], hi[i], lo[j], hi[j]], 1)


class _Sums:
    """Pairs summed in bounded memory."""

    def __init__(self) -> None:
        self.held = np.zeros((0, 7), np.int64)

    def add(self, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held = np.concatenate([self.held, x])
        if len(self.held) > 1 << 20:
            self.held = _summed(self.held)
            if len(self.held) > 1 << 19:
                yield self.rest()
                self.held = self.held[:0]

    def rest(self) -> pa.RecordBatch:
        return _pair_batch(_summed(self.held), False)


def candidates(rows: DataFrame, percent: int, partitions: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of groups, a < b, whose unions of prefixes share as many shingles as a link between members needs.

    A shingle of more than `WIDE` groups is dealt out: its groups go to tiles of two blocks of some `WIDE` groups each, which
    are paired by as many tasks, so no task pairs all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for table in whole_groups(batches, "token", 1 << 17):
            c = {x: table.column(x).to_numpy() for x in table.column_names}
            m = _merged(*(c[x] for x in ("token", "gid", "nmin", "nmax", "place")))
            token, gid, lo, hi, _ = (m.column(x).to_numpy() for x in ("token", "gid", "nmin", "nmax", "place"))
            at = bounds(token)
            wide = np.flatnonzero(np.diff(at) > WIDE)
            for k in wide:
                g, blocks = slice(at[k], at[k + 1]), min(BLOCKS, -(-int(at[k + 1] - at[k]) // WIDE))
                own = (mix(gid[g].view(np.uint64) ^ np.uint64(token[at[k]] & (1 << 62) - 1)) % np.uint64(blocks)).astype(np.int64)
                for other in range(blocks):
                    least, most = np.minimum(own, other), np.maximum(own, other)
                    name = mix(np.array([token[at[k]]], np.int64).view(np.uint64) + (least * blocks + most + 1).astype(np.uint64) * _S1).view(np.int64)
                    yield _pair_batch(np.stack([gid[g], own, (own == other).astype(np.int64), lo[g], hi[g], name, np.zeros(len(own), np.int64)], 1), True)
            if len(wide):
                few = np.ones(len(token), bool)
                few[_ranges(at[wide], np.diff(at)[wide])] = False
                token, gid, lo, hi = token[few], gid[few], lo[few], hi[few]
            for x in _paired(token, gid, lo, hi, percent):
                yield from sums.add(x)
        yield sums.rest()

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for table in whole_groups(batches, "lb", 1 << 14):
            gid, own, same, lo, hi, tile = (table.column(x).to_numpy() for x in _PAIR[:6])
            for one in (True, False):  # within a block, or between two
                sel = np.flatnonzero((same == 1) == one)
                for x in _paired(tile[sel], gid[sel], lo[sel], hi[sel], percent, None if one else own[sel]):
                    yield from sums.add(x)
        yield sums.rest()

    kind = ", ".join(f"{x} long" for x in _PAIR) + ", deferred boolean"
    found = scratch.keep(rows.repartition(partitions, "token").sortWithinPartitions("token").mapInArrow(lean(run), kind), "shared")
    pairs, deferred = found.where("not deferred"), found.where("deferred")
    if not deferred.isEmpty():
        pairs = pairs.unionByName(deferred.repartition(partitions, "lb").sortWithinPartitions("lb").mapInArrow(lean(tiles), kind))
    sums = pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"), *(f(x).alias(x) for f, x in ((F.min, "la"), (F.max, "ha"), (F.min, "lb"), (F.max, "hb"))))
    overlap = F.ceil((F.col("la") + F.col("lb")) * percent / (100 + percent) - 1e-9)
    return sums.where(F.col("shared") >= overlap - F.ceil(F.greatest("ha", "hb") * percent / 100 - 1e-9) + 1).select("a", "b")


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())


class _Block:
    """Members' sets by token, to count the overlaps of a query with all of them at once."""

    def __init__(self, sets: list[np.ndarray], rows: np.ndarray):
        self.rows = rows
        tokens = np.concatenate([sets[r] for r in rows]) if len(rows) else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], owner[order]
        self.n = np.array([len(sets[r]) for r in rows])

    def linked(self, query: np.ndarray, percent: int) -> np.ndarray:
        lo = np.searchsorted(self.tokens, query, "left")
        n = np.searchsorted(self.tokens, query, "right") - lo
        both, sums, at = np.zeros(len(self.n), np.int64), np.cumsum(n), 0
        while at < len(n):  # a million hits at a time
            to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + HITS, "right")))
            both += np.bincount(self.owner[_ranges(lo[at:to], n[at:to])], minlength=len(self.n))
            at = to
        return np.flatnonzero((both > 0) & (100 * both >= percent * (self.n + len(query) - both)))


def _search(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Component of each member (the least row of it), by search over those not yet reached."""
    label = np.full(len(sets), -1)
    left = _Block(sets, np.arange(len(sets)))
    gone = np.zeros(len(sets), bool)
    for s in range(len(sets)):
        if label[s] >= 0:
            continue
        label[s], gone[s] = s, True
        queue = [s]
        while queue:
            found = left.rows[left.linked(sets[queue.pop()], percent)]
            found = found[~gone[found]]
            label[found], gone[found] = s, True
            queue += found.tolist()
            if (keep := left.rows[~gone[left.rows]]).size * 2 <= len(left.rows):
                left = _Block(sets, keep)
                if not len(keep):
                    break
    return label


def open_groups(rows: DataFrame, percent: int, partitions: int, search: bool = True) -> DataFrame:
    """Links (a, b) that connect what is linked. `rows`: target (the opened block), member (boolean, else a query), cls, rep, tokens. Members are held against each other if asked for; else a link names what its member is known as (`rep`), once for all members of that name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members, block, label, ids = None, {}, None, None, None
        a: list[int] = []
        b: list[int] = []

        def build() -> None:
            """All members have come: they stand first."""
            nonlocal block, label, ids
            sets = [t for t, _ in members.values()]
            if not search:
                ids, label = np.unique(np.array([r for _, r in members.values()], np.int64), return_inverse=True)
            else:
                ids, label = np.array(list(members), np.int64), _search(sets, percent)
                far = np.flatnonzero(label != np.arange(len(ids)))
                a.extend(ids[far].tolist())
                b.extend(ids[label[far]].tolist())
            block = _Block(sets, np.arange(len(sets)))

        for batch in batches:
            for target, member, cls, rep, tokens in zip(*(batch.column(x).to_pylist() for x in ("target", "member", "cls", "rep", "tokens"))):
                if target != now:
                    if search and members and block is None:
                        build()
                    now, members, block = target, {}, None
                if member:
                    members[cls] = np.frombuffer(tokens, np.uint64), rep
                    continue
                if block is None:
                    build()
                if len(ids) and not (search and cls in members):
                    to = np.unique(label[block.linked(np.frombuffer(tokens, np.uint64), percent)])
                    a.extend([cls] * len(to))
                    b.extend(ids[to].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a.clear()
            b.clear()
        if search and members and block is None:
            build()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.select("target", "member", "cls", "rep", "tokens").repartition(partitions, "target").sortWithinPartitions("target", F.desc("member")).mapInArrow(lean(run), "a long, b long")


def link(docs: DataFrame, k: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, cls (the class of equal sets; 0 for the empty one), label (of the component; null for the empty set) and hash (of the text), one row a document."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    p = parts(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    frequent = spark.sparkContext.broadcast(_frequent(docs, k, scratch))
    sigs = scratch.keep(signatures(docs, k, percent, frequent), "signatures")
    classes = scratch.keep(sigs.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("key0").alias("key0"), F.min("key1").alias("key1"), F.min("n").alias("n")), "classes")

    # similar documents: the shares of the least-hash shingles are opened, in blocks; a block's first member is also asked of the share's other blocks
    keyed = classes.select("cls", "doc_id", "n", "key0", F.explode(F.array_distinct(F.array("key0", "key1"))).alias("key"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES))
    shares = keyed.groupBy("key").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("m")).where("m > 1")
    near = scratch.keep(keyed.join(shares, "key").select("cls", "doc_id", "key", "key0", "blocks", F.pmod("cls", "blocks").alias("block")), "near")
    wide = near.where("blocks > 1").groupBy("key", "block", "blocks").agg(F.min("cls").alias("cls"))
    wide = wide.select("cls", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("member"))
    ask = near.select("cls", "key", "block", F.lit(True).alias("member")).unionByName(wide).select("cls", F.xxhash64("key", "block").alias("target"), "member", F.col("cls").alias("rep"))
    sets = scratch.keep(_tokens(docs, near.select("cls", "doc_id").distinct(), k, frequent), "near-sets")
    edges = scratch.keep(open_groups(ask.join(sets, "cls"), percent, p), "near-edges")
    scratch.drop("near-sets")
    groups = components(scratch, edges, "groups")

    # the matrix over the groups: what is linked is one group, and else what was compared in one block by the first key;
    # all pairs within a group have been compared, so what is left are pairs of different groups
    known = groups.select(F.col("node").alias("cls"), F.col("label").alias("label"))
    beside = near.where("key = key0").select("cls", F.xxhash64("key", "block").alias("beside"))
    grouped = scratch.keep(known.join(beside, "cls", "full").select("cls", F.coalesce("label", "beside").alias("gid"), F.coalesce("label", "cls").alias("rep")), "grouped")
    rows = sigs.where("n > 0").join(_small(grouped), "cls", "left").select(F.coalesce("gid", "cls").alias("gid"), "n", "prefix")
    pairs = scratch.keep(candidates(matrix(rows), percent, 2 * p, scratch), "pairs")
    of = classes.join(_small(grouped), "cls", "left").select("cls", "doc_id", "n", F.coalesce("gid", "cls").alias("gid"), F.coalesce("rep", "cls").alias("rep"))
    asked = scratch.keep(of.join(_small(pairs.select(F.explode(F.array("a", "b")).alias("gid")).distinct()), "gid", "left_semi"), "asked")
    size = asked.groupBy("gid").agg(F.count(F.lit(1)).alias("m"), blocks.alias("blocks"))
    a, b = (size.select(F.col("gid").alias(x), F.col("m").alias(f"m{x}"), F.col("blocks").alias(f"blocks{x}")) for x in "ab")
    smaller = F.col("ma") < F.col("mb")
    into = pairs.join(a, "a").join(b, "b").select(F.when(smaller, F.col("a")).otherwise(F.col("b")).alias("gid"), F.when(smaller, F.col("b")).otherwise(F.col("a")).alias("into"), F.when(smaller, F.col("blocksb")).otherwise(F.col("blocksa")).alias("blocks"), F.least("ma", "mb").alias("asking"))
    # a group that many others are held against: its queries are parted by a hash, and its blocks repeated for every part
    opened = scratch.keep(into.groupBy(F.col("into").alias("gid")).agg(F.max("blocks").alias("blocks"), F.ceil(F.sum("asking") / ASKED).alias("asks")), "opened")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    members = asked.join(_small(opened), "gid").select("cls", "rep", "gid", F.pmod("cls", "blocks").alias("block"), each("asks").alias("ask"))
    members = members.select("cls", F.xxhash64("gid", "block", "ask").alias("target"), F.lit(True).alias("member"), "rep")
    into = into.join(_small(opened.select(F.col("gid").alias("into"), "asks")), "into")
    queries = asked.join(into, "gid").select("cls", "rep", "into", F.pmod(F.xxhash64("cls"), "asks").alias("ask"), each("blocks").alias("block"))
    queries = queries.select("cls", F.xxhash64("into", "block", "ask").alias("target"), F.lit(False).alias("member"), "rep")
    sets = scratch.keep(_tokens(docs, asked.select("cls", "doc_id"), k, frequent), "asked-sets")
    more = scratch.keep(open_groups(members.unionByName(queries).join(sets, "cls"), percent, p, search=False), "edges")
    scratch.drop("asked-sets")

    # links between groups, over what each class is known as
    across = more.join(_small(grouped.select(F.col("cls").alias("a"), F.col("rep").alias("ra"))), "a", "left").select(F.coalesce("ra", "a").alias("a"), "b")
    merged = components(scratch, across, "merged")
    named = of.join(merged, F.col("rep") == F.col("node"), "left").select("cls", "doc_id", F.coalesce("label", "rep").alias("label"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    final = scratch.keep(named.join(least, "label").select("cls", "component_id", "label"), "final")
    out = sigs.select("doc_id", F.col("n").alias("n_shingles"), "cls", "hash").join(final, "cls", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "cls", "label", "hash")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if it is counted and small enough; else the optimizer's choice."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def _tokens(docs: DataFrame, wanted: DataFrame, k: int, frequent) -> DataFrame:
    """cls, tokens: the whole sets of the wanted classes (cls, doc_id), from the texts of their representatives."""
    wanted = _small(wanted.withColumnRenamed("doc_id", "rep"))
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep"))).select("cls", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                h, to = _sets(b, k, frequent.value)
                cls = b.column("cls").to_numpy()
                own = np.flatnonzero(_classes(h, to).view(np.int64) == cls)  # another text of the same id is not meant
                yield pa.RecordBatch.from_arrays([pa.array(cls[own]), pa.array([h[to[d] : to[d + 1]].tobytes() for d in own], pa.binary())], ["cls", "tokens"])

    return texts.mapInArrow(lean(run), "cls long, tokens binary")


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """The documents' own columns; of each group of linked documents one stays, that with the least doc_id (null after all others) and then the least hash of its text, once if its row is repeated. Ids need not be unique: a document is told by id and text. Documents with the empty set all stay."""
    scratch = scratch or Scratch(docs.sparkSession)
    found = scratch.keep(link(docs, k, percent, scratch).where("n_shingles > 0").groupBy("label", "doc_id", "hash").agg(F.count(F.lit(1)).alias("n")), "found")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    best = found.groupBy("label").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("m")).where("m > 1").select("label", "best")
    gone = found.join(best, "label").where(rank != F.col("best")).select(F.col("doc_id").alias("_gone"), F.col("hash").alias("_text"))
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_hash"))
    same = F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_hash") == F.col("_text"))
    kept = rows.join(gone, same, "left_anti")
    twice = found.where("n > 1").select(F.col("doc_id").alias("_gone"), F.col("hash").alias("_text"))
    if not twice.isEmpty():
        kept = kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates(["_id", "_hash"]))
    return kept.select("doc.*")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read(spark, sf_dir, "documents", spread=True), 4, 85).select("doc_id", "n_shingles", "component_id")

