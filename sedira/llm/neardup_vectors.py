"""Embedding near-duplicates by NN-descent.

1. Equal vectors are one class from there on.
2. Neighbour lists are seeded from a forest of sign hashes: in each tree, vectors with the same signs against some random
   planes meet in a leaf, and each gets its nearest ones there. The number of trees follows from the number of planes, so
   that a single pair right at the threshold is met with the asked probability whatever the size of the input and of the
   leaf: all pairs of a heavy leaf meet, or it has a forest of its own with as small a chance to miss one.
3. The graph is refined: all neighbours of a vector, in either direction, are compared with each other, and every list
   keeps its nearest, until hardly any link is new. Lists hold only what lies above the cosine that two steps of the
   threshold can bridge, as nothing farther leads to a link; most vectors have no list at all.
4. Lists that are saturated (full of links) are enlarged, to twice as many neighbours at a time, and the graph is refined
   again around them, until none is saturated or the lists have `K_MOST` neighbours. Beyond that a list takes more room than
   the comparison of step 6 takes time, and that step is what finds the rest.
5. Recall is audited: a bounded sample of vectors is held against all, in blocks; if they meet a smaller share of their
   links than asked, on average over those vectors, another forest with other planes is added and the graph refined again;
   if that does not help either, the query fails.
6. Links at or above the threshold give connected components. Wherever vectors are compared, all that links join there name
   one of them as their root, also those that a full list leaves out. Within each component, all members are compared, in
   tiles, which makes the links exact there.

All similarities are computed in double precision from the given components, scaled by the largest of them first, so that
no norm overflows or vanishes.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different
lengths do not link; repeated rows are copies and link; a null vec_id comes after all others; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedira.llm.common import bounds, components, lean, packed_lists, parts, read, Scratch, whole_groups

#: Neighbours in a list; vectors in a leaf on average, and compared at once at most; members of a pivot's or component's tile.
K, LEAF, LEAF_MOST, TILE = 16, 256, 4096, 1024
#: Neighbours in a list that was enlarged, at most; rows of lists that a task merges at a time.
K_MOST, HELD = 64, 1 << 19
#: Planes of a tree that parts a leaf; blocks of LEAF_MOST / 2 up to which a leaf is never parted.
MORE, BLOCKS = 10, 16
#: Chance to miss a lone pair at the threshold in the forest; queries of the audit, the recall it asks for, forests at most.
MISS, AUDIT, RECALL, FORESTS = 1e-3, 256, 0.99, 3


def classes(vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(vec_id, cls: null if the vector links with nothing) of each row; (cls, vec, dim, n, first_id) of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            lists = b.column("embedding")
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            kind = flat.type.to_pandas_dtype()
            at = np.concatenate([[0], np.cumsum(n)])
            y = flat.to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # one zero; a null is not a number
            full = np.flatnonzero(n)
            good = np.zeros(len(n), bool)
            if len(full):
                most = np.maximum.reduceat(np.abs(y), at[full])  # NaN where there is one
                good[full] = np.isfinite(most) & (most > 0)
            raw, width = memoryview(y.tobytes()), y.dtype.itemsize
            vec = [bytes(raw[at[k] * width : at[k + 1] * width]) if good[k] else None for k in range(len(n))]
            cls = [None if v is None else xxhash.xxh3_64_intdigest(v) - (1 << 63) for v in vec]
            dim = pa.array(n.astype(np.int32), mask=~good)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").cast(pa.int64()), pa.array(cls, pa.int64()), pa.array(vec, pa.binary()), dim], ["vec_id", "cls", "vec", "dim"])

    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    rows = scratch.keep(vectors.select("vec_id", F.col("embedding").cast("array<float>" if kind == "float" else "array<double>")).mapInArrow(lean(run), "vec_id long, cls long, vec binary, dim int"), "rows")
    by = rows.where("cls is not null").groupBy("cls").agg(F.first("vec").alias("vec"), F.first("dim").alias("dim"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"))
    return rows.select("vec_id", "cls"), scratch.keep(by, "classes")


def _unit(raw: list[bytes], dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float32 if len(raw[0]) == 4 * dim else np.float64).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _planes(seed: int, tree: int, bits: int, dim: int) -> np.ndarray:
    return np.random.default_rng([seed, tree, dim]).standard_normal((dim, bits))


def _lists(x: np.ndarray, ids: np.ndarray, floor: float, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector, the k nearest others at or above the floor, as rows (own, other, similarity); and rows (own, root) of the vectors that links (at or above `least`) join to others here, also by links that a full list leaves out."""
    rows, root = [np.zeros((0, 3), np.int64)], np.arange(len(x))
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -2
        hit = s >= floor
        for r in np.flatnonzero(hit.any(1)):
            to = np.flatnonzero(hit[r])
            own = np.unique(root[np.append(to[s[r, to] >= least], at + r)])
            if len(own) > 1:
                root[np.isin(root, own)] = own[0]
            if len(to) > k:
                to = to[np.argpartition(-s[r, to], k)[:k]]
            rows.append(np.stack([np.full(len(to), ids[at + r]), ids[to], s[r, to].view(np.int64)], 1))
    far = np.flatnonzero(root != np.arange(len(x)))
    return np.concatenate(rows), np.stack([ids[far], ids[root[far]]], 1)


def _nearest(x: np.ndarray, k: int) -> np.ndarray:
    """Rows (own, other, similarity), each pair once, the k nearest of each own, sorted by own."""
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    x = x[np.concatenate([[True], (x[1:, :2] != x[:-1, :2]).any(1)])] if len(x) else x
    x = x[np.lexsort((-x[:, 2].view(np.float64), x[:, 0]))] if len(x) else x
    at = bounds(x[:, 0])
    return x[np.arange(len(x)) - np.repeat(at[:-1], np.diff(at)) < k]


def _list_batch(x: np.ndarray, roots: np.ndarray) -> pa.RecordBatch:
    """Sorted rows of lists as one row a list (cls, ids, sims), and rows (cls, root) beside them."""
    own, *packed = packed_lists(x[:, 0], x[:, 1], x[:, 2])
    none = pa.nulls(len(roots), pa.binary())
    cols = [pa.concat_arrays([own, pa.array(roots[:, 0])]), *(pa.concat_arrays([p, none]) for p in packed), pa.concat_arrays([pa.nulls(len(own), pa.int64()), pa.array(roots[:, 1])])]
    return pa.RecordBatch.from_arrays(cols, ["cls", "ids", "sims", "root"])


def _neighbours(rows: DataFrame, key: str, floor: float, least: float, k: int, partitions: int) -> DataFrame:
    """Within the groups of `key`: lists (cls, ids, sims), and roots (cls, root; the others null); rows: key, cls, vec, dim. A task merges what it has found for a vector before it gives it away, so the lists of a vector that many groups hold are as many as the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, roots, size = [np.zeros((0, 3), np.int64)], [np.zeros((0, 2), np.int64)], 0
        for table in whole_groups(batches, key, 2048):
            keys, ids, dims = (table.column(c).to_numpy() for c in (key, "cls", "dim"))
            raw = table.column("vec").to_pylist()
            at = bounds(keys)
            for s, e in zip(at[:-1], at[1:]):
                _, one = np.unique(ids[s:e], return_index=True)
                if len(one) > 1:
                    x, r = _lists(_unit([raw[s + i] for i in one], int(dims[s])), ids[s:e][one], floor, least, k)
                    lists.append(x)
                    roots.append(r)
                    size += len(x)
            if size > HELD:
                x = _nearest(np.concatenate(lists), k)
                if len(x) > HELD // 2:
                    yield _list_batch(x, np.unique(np.concatenate(roots), axis=0))
                    x, roots = x[:0], roots[:1]
                lists, size = [x], len(x)
        yield _list_batch(_nearest(np.concatenate(lists), k), np.unique(np.concatenate(roots), axis=0))

    return rows.repartition(partitions, key).sortWithinPartitions(key).mapInArrow(lean(run), "cls long, ids binary, sims binary, root long")


def trees_for(bits: int, threshold: float) -> int:
    """Trees with `bits` planes each that a pair at the threshold is missed by with a chance of MISS at most, also if each tree's leaves are parted by a forest that misses as much."""
    together = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return 1 if together > 0.9999 else math.ceil(math.log(MISS) / math.log(1 - together * (1 - MISS)))


def _parted(rows: DataFrame, trees: int, subs: int, seed: int) -> DataFrame:
    """(leaf, sub, cls, vec, dim): the rows of each leaf in the leaves of a forest of its own, of `subs` trees of MORE planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        weights = 1 << np.arange(MORE, dtype=np.int64)
        for b in batches:
            dims, tree = b.column("dim").to_numpy(), (b.column("leaf").to_numpy() >> 16) % trees
            for dim, t in sorted(set(zip(dims.tolist(), tree.tolist()))):
                part = b.take(pa.array(np.flatnonzero((dims == dim) & (tree == t))))
                x = _unit(part.column("vec").to_pylist(), dim)
                if (dim, t) not in planes:
                    planes[dim, t] = np.random.default_rng([seed, t, dim, 1]).standard_normal((subs, dim, MORE))
                for k, p in enumerate(planes[dim, t]):
                    yield pa.RecordBatch.from_arrays([part.column("leaf"), pa.array(k << MORE | (x @ p > 0) @ weights), *(part.column(c) for c in ("cls", "vec", "dim"))], ["leaf", "sub", "cls", "vec", "dim"])

    return rows.select("leaf", "cls", "vec", "dim").mapInArrow(lean(run), "leaf long, sub long, cls long, vec binary, dim int")


def _tiled(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """The rows with the leaves of `heavy` (leaf, m) dealt out in tiles of two blocks each, in one of which any two of a leaf meet."""
    rows = rows.select("leaf", "cls", "vec", "dim").join(heavy, "leaf", "left").withColumn("blocks", F.coalesce(F.ceil(2 * F.col("m") / LEAF_MOST), F.lit(1)).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cls", "leaf"), F.col("blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: (o != F.col("own")) | (F.col("blocks") == 1))
    rows = rows.withColumn("other", F.explode(others))
    tile = F.xxhash64("leaf", F.least("own", "other"), F.greatest("own", "other"))
    return rows.select(F.when(F.col("blocks") == 1, F.col("leaf")).otherwise(tile).alias("leaf"), "cls", "vec", "dim")


def forest(by: DataFrame, bits: int, trees: int, seed: int, floor: float, least: float, k: int, scratch: Scratch) -> DataFrame:
    """Lists from the leaves of `trees` trees. In a leaf over LEAF_MOST, all pairs are compared in tiles; one of more than BLOCKS blocks is parted first by a forest of its own, if that leaves fewer pairs to compare (it does not if its vectors are nearly one)."""
    spark = by.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, list[np.ndarray]] = {}
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                part = b.take(pa.array(rows))
                x = _unit(part.column("vec").to_pylist(), dim)
                if dim not in planes:
                    planes[dim] = [_planes(seed, t, bits, dim) for t in range(trees)]
                weights = 1 << np.arange(bits, dtype=np.int64)
                for t, p in enumerate(planes[dim]):
                    leaf = (((x @ p > 0) @ weights) * trees + t) * 65536 + dim % 65536
                    yield pa.RecordBatch.from_arrays([pa.array(leaf), *(part.column(c) for c in ("cls", "vec", "dim"))], ["leaf", "cls", "vec", "dim"])

    rows = by.select("cls", "vec", "dim").mapInArrow(lean(run), "leaf long, cls long, vec binary, dim int")
    heavy = scratch.keep(rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > LEAF_MOST), f"heavy{seed}")
    if not heavy.isEmpty():
        wide = heavy.where(2 * F.col("m") > BLOCKS * LEAF_MOST)
        subs = trees_for(MORE, least)
        if wide.isEmpty():
            rows = _tiled(rows, heavy)
        else:
            sizes = scratch.keep(_parted(rows.join(wide, "leaf", "left_semi"), trees, subs, seed).groupBy("leaf", "sub").agg(F.count(F.lit(1)).alias("m")), f"parts{seed}")
            pairs = sizes.groupBy("leaf").agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("pairs"))
            pay = scratch.keep(wide.join(pairs, "leaf").where(F.col("pairs") < F.col("m").cast("double") * F.col("m")).select("leaf"), f"parted{seed}")
            named = F.xxhash64("leaf", "sub").alias("leaf")
            inner = sizes.where(F.col("m") > LEAF_MOST).join(pay, "leaf", "left_semi").select(named, "m")
            parted = _parted(rows.join(pay, "leaf", "left_semi"), trees, subs, seed).select(named, "cls", "vec", "dim")
            rows = _tiled(rows.join(pay, "leaf", "left_anti"), heavy).unionByName(_tiled(parted, inner))
    return _neighbours(rows, "leaf", floor, least, k, parts(spark))


def merge(lists: DataFrame, k: int, partitions: int) -> DataFrame:
    """One list of the k nearest for each vector. Lists are exchanged by vector and read in order, so none is gathered with others but those of its vector that are read together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, own, held = np.zeros((0, 2), np.int64), None, np.zeros((0, 3), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            ids, sims = (b.column(c).to_pylist() for c in ("ids", "sims"))
            cls = np.repeat(b.column("cls").to_numpy(), [len(i) // 8 for i in ids])
            x = np.stack([cls, np.frombuffer(b"".join(ids), np.int64), np.frombuffer(b"".join(sims), np.int64)], 1)
            x = _nearest(np.concatenate([held, x]), k)
            own = x[-1, 0]
            last = x[:, 0] == own  # its lists may go on in the next batch
            yield _list_batch(x[~last], none)
            held = x[last]
        yield _list_batch(held, none)

    rows = lists.select("cls", "ids", "sims").repartition(partitions, "cls").sortWithinPartitions("cls")
    return rows.mapInArrow(lean(run), "cls long, ids binary, sims binary, root long").drop("root")


def saturated(lists: DataFrame, k: int, threshold: float) -> DataFrame:
    """(cls): lists of k links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            full = [len(s) >= 8 * k and np.frombuffer(s, np.float64).min() >= threshold for s in b.column("sims").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("cls").filter(pa.array(full, pa.bool_()))], ["cls"])

    return lists.mapInArrow(lean(run), "cls long")


def edges_of(lists: DataFrame, least: float) -> DataFrame:
    """(a, b) of the lists' entries at or above `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("ids").to_pylist()
            ids, sims = np.frombuffer(b"".join(raw), np.int64), np.frombuffer(b"".join(b.column("sims").to_pylist()), np.float64)
            own = np.repeat(b.column("cls").to_numpy(), [len(r) // 8 for r in raw])
            ok = sims >= least
            yield pa.RecordBatch.from_arrays([pa.array(own[ok]), pa.array(ids[ok])], ["a", "b"])

    return lists.mapInArrow(lean(run), "a long, b long")


def refine(lists: DataFrame, by: DataFrame, floor: float, least: float, k: int, around: DataFrame | None = None) -> DataFrame:
    """Lists of a turn of the descent, to be merged: neighbours of neighbours, in either direction, are compared; a pivot with many is dealt out in tiles. `around` (cls): only pivots that are neighbours of these."""
    e = edges_of(lists, floor)
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(e.select("a", F.col("a").alias("b"))).distinct()
    if around is not None:
        pivots = both.join(around.select(F.col("cls").alias("b")), "b", "left_semi").select("a").distinct()
        both = both.join(pivots, "a", "left_semi")
    wide = both.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("ways"))
    dealt = both.join(wide, "a").select(F.xxhash64("a", F.pmod(F.xxhash64("b", "a"), F.col("ways"))).alias("pivot"), F.col("b").alias("cls"))
    rows = dealt.join(by.select("cls", "vec", "dim"), "cls")
    return _neighbours(rows.select("pivot", "cls", "vec", "dim"), "pivot", floor, least, k, parts(by.sparkSession))


def audit(by: DataFrame, threshold: float, queries: int = AUDIT) -> DataFrame:
    """(a, b): all links of a bounded sample of vectors, by comparison with every vector."""
    chosen = by.orderBy(F.xxhash64("cls", F.lit(11)), "cls").limit(queries).select("cls", "vec", "dim").collect()  # `queries` vectors
    shared = by.sparkSession.sparkContext.broadcast([(r["cls"], bytes(r["vec"]), r["dim"]) for r in chosen])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, ids, raw = b.column("dim").to_numpy(), b.column("cls").to_numpy(), b.column("vec").to_pylist()
            for dim in np.unique(dims).tolist():
                asked = [q for q in shared.value if q[2] == dim]
                rows = np.flatnonzero(dims == dim)
                if asked:
                    own = np.array([q[0] for q in asked])
                    i, j = np.nonzero(_unit([q[1] for q in asked], dim) @ _unit([raw[r] for r in rows], dim).T >= threshold)
                    ok = own[i] != ids[rows][j]
                    yield pa.RecordBatch.from_arrays([pa.array(own[i][ok]), pa.array(ids[rows][j][ok])], ["a", "b"])

    return by.mapInArrow(lean(run), "a long, b long")


def count_links(members: DataFrame, threshold: float, partitions: int) -> DataFrame:
    """(cls, links): links to other classes, by number of vectors. `members`: label, cls, vec, dim, n, size (of the component). Tiles of two blocks each; a component of up to TILE members is one tile."""
    blocks = F.ceil(F.col("size") / TILE).cast("int")
    rows = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cls", F.lit(13)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(F.xxhash64("label", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), (F.col("own") <= F.col("other")).alias("left"), (F.col("own") == F.col("other")).alias("same"), "cls", "vec", "dim", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "tile", 2048):
            tile, cls, dims, n = (table.column(c).to_numpy() for c in ("tile", "cls", "dim", "n"))
            left, same = (table.column(c).to_numpy(zero_copy_only=False) for c in ("left", "same"))
            raw = table.column("vec").to_pylist()
            at = bounds(tile)
            out_c, out_n = [], []
            for s, e in zip(at[:-1], at[1:]):
                x = _unit(raw[s:e], int(dims[s]))
                if same[s]:
                    hit = x @ x.T >= threshold
                    np.fill_diagonal(hit, False)
                    out_c.append(cls[s:e])
                    out_n.append(hit @ n[s:e])
                else:
                    a, b = np.flatnonzero(left[s:e]), np.flatnonzero(~left[s:e])
                    hit = x[a] @ x[b].T >= threshold
                    out_c += [cls[s:e][a], cls[s:e][b]]
                    out_n += [hit @ n[s:e][b], hit.T @ n[s:e][a]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_c)), pa.array(np.concatenate(out_n).astype(np.int64))], ["cls", "links"])

    return rows.repartition(partitions, "tile").sortWithinPartitions("tile").mapInArrow(lean(run), "cls long, links long").groupBy("cls").agg(F.sum("links").alias("links"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, k: int = K, scratch: Scratch | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row a row of `vectors` (vec_id, embedding)."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark)
    rows, by = classes(vectors, scratch)
    n = by.count()
    floor = max(-1.0, 2 * threshold * threshold - 1) if threshold > 0.5 else -1.0
    bits = max(0, round(math.log2(max(n, 1) / LEAF)))
    trees = trees_for(bits, threshold)
    lists, joined, found = None, None, 0

    def take(new: DataFrame, name: str) -> None:
        """Merges new lists into `lists`, and their roots into `joined`."""
        nonlocal lists, joined
        new = scratch.keep(new, f"{name}-new")
        roots = scratch.keep(new.where("root is not null").select(F.col("cls").alias("a"), F.col("root").alias("b")), f"{name}-roots")
        joined = roots if joined is None else joined.unionByName(roots)
        new = new.where("root is null").drop("root")
        lists = scratch.keep(merge(new if lists is None else lists.unionByName(new), k, parts(spark)), name)
        scratch.drop(f"{name}-new")

    def descend(name: str, around: DataFrame | None = None) -> None:
        """Refines until hardly any link is new; each turn joins neighbours of neighbours, so distances double."""
        nonlocal found
        for step in itertools.count():
            take(refine(lists, by, floor, threshold, k, around), f"{name}-{step}")
            before, found = found, edges_of(lists, threshold).count()
            if found <= before * 1.001:
                break

    truth = scratch.keep(audit(by, threshold), "audit")
    for turn in range(FORESTS):
        take(forest(by, bits, trees, turn, floor, threshold, k, scratch), f"lists{turn}")
        found = edges_of(lists, threshold).count()
        descend(f"lists{turn}")
        while k < K_MOST:
            full = scratch.keep(saturated(lists, k, threshold), f"full{turn}-{k}")
            if full.isEmpty():
                break
            k *= 2
            descend(f"lists{turn}-{k}", full)
        labels = components(scratch, joined, f"cc{turn}")
        a, b = (labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
        met = truth.join(a, "a", "left").join(b, "b", "left").groupBy("a").agg(F.avg(F.coalesce((F.col("la") == F.col("lb")).cast("double"), F.lit(0.0))).alias("share"))
        recall = met.agg(F.coalesce(F.avg("share"), F.lit(1.0)).alias("recall")).first()["recall"]
        if recall >= RECALL:
            break
    else:
        raise RuntimeError(f"a recall of {recall:.4f} after {FORESTS} forests, below {RECALL}")
    size = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    members = labels.withColumnRenamed("node", "cls").join(size, "label").join(by, "cls")
    links = count_links(members, threshold, parts(spark))
    first = members.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of = labels.join(first, "label").select(F.col("node").alias("cls"), "component_id").join(links, "cls", "left")
    known = by.select("cls", "n", "first_id").join(of, "cls", "left").select("cls", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id"))
    out = rows.join(known, "cls", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_neardup_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
