"""Most similar vectors for every vector: NN-descent as iterative Spark joins.

Plan, with N vectors and k neighbours:

1. Usable vectors become unit vectors of 16-bit integers; equal directions become one node with its
   smallest k + 1 ids, so that copies never enter the graph twice.
2. A forest of hyperplane trees, fitted on a bounded sample, puts each node into one cell per tree. The
   neighbours inside each cell are exact and form the first graph.
3. NN-descent: the graph joins itself on the middle node. Of the neighbours of neighbours only pairs that
   never shared a cell (ends of two edges in a row, or of two edges of one node), and that some edge of the last round leads to, are new; their vectors are fetched
   by two joins and both ends keep their best. Rounds end when less than ``delta`` of the edges change.
   Nodes and graph are bucketed by node, so a round moves edges and pairs, never the two tables.

A cell that holds more than ``cell_rows`` rows is parted by a tree of its own, fitted on a bounded sample
of its rows while they stream past. Its parts are cells of their own: a pair of two parts has not met.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wrenlake.session import cut, drop

SCALE = 32767
#: an edge: the neighbour, its cells, the similarity and the number of its ids
EDGE = np.dtype([("v", "<i8"), ("pack", "<i8"), ("s", "<f4"), ("n", "u1")])
GRAPH = "u long, pack long, n int, nb binary"
TREES = 3
#: a tree's code in pack: the leaf, or of a leaf that is parted a hash of leaf and part
CODE_BITS = 20
PARTS = 2**10
#: set in an edge's pack until the descent has followed it
FRESH = 1 << (TREES * CODE_BITS)
PART_SAMPLE = 4096
#: rows of a cell that are compared with all others at a time
BLOCK = 1024


# ---------------------------------------------------------------- vectors


def unit_rows(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that have a direction, and the mask of these rows."""
    x = values.reshape(-1, width).astype("f8")
    good = np.isfinite(x).all(axis=1)
    x[~good] = 0
    top = np.abs(x).max(axis=1, initial=0)
    good &= top > 0
    x = x[good] / top[good, None]  # first, so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1)[:, None], good


def quantise(x: np.ndarray) -> np.ndarray:
    return np.round(x * SCALE).astype("<i2")


def from_blobs(blobs: pa.Array, width: int) -> np.ndarray:
    """Unit float vectors of a column of 16-bit blobs."""
    col = blobs.combine_chunks() if isinstance(blobs, pa.ChunkedArray) else blobs
    raw = b"".join(col.to_pylist()) if col.null_count else _bytes_of(col)
    x = np.frombuffer(raw, "<i2").reshape(-1, width).astype("f4")
    return x / np.linalg.norm(x.astype("f8"), axis=1).astype("f4")[:, None]


def _bytes_of(col: pa.Array) -> bytes:
    if len(col) == 0:
        return b""
    offsets = np.frombuffer(col.buffers()[1], "<i4")[col.offset : col.offset + len(col) + 1]
    return col.buffers()[2][int(offsets[0]) : int(offsets[-1])].to_pybytes()


def _blobs(x: np.ndarray) -> pa.Array:
    """Each row of a 2-d array, or each item of a structured one, as one binary value."""
    raw = np.ascontiguousarray(x)
    n = len(raw)
    size = raw.nbytes // n if n else 0
    offsets = np.arange(n + 1, dtype="<i4") * size
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


# ---------------------------------------------------------------- forest


def build_forest(models: list, vectors: np.ndarray, trees: int = TREES, leaf: int = 64, seed: int = 7) -> dict:
    """{model: [tree, ...]}; a tree is (normals, thresholds, children), children < 0 being ~leaf.

    Each split parts a node's sample between two centres found by three rounds of 2-means.
    """
    rng = np.random.default_rng(seed)
    by_model: dict = {}
    for i, m in enumerate(models):
        by_model.setdefault(m, []).append(i)
    forest = {}
    for m in sorted(by_model):
        x = vectors[by_model[m]]
        forest[m] = [_build_tree(x, leaf, rng) for _ in range(trees)]
    return forest


def _build_tree(x: np.ndarray, leaf: int, rng: np.random.Generator, most: int = 2 ** (CODE_BITS - 1)) -> tuple:
    normals, thresholds, children = [], [], []
    leaves = 0
    todo = [(np.arange(len(x)), -1, 0)]
    while todo:
        idx, parent, side = todo.pop()
        split = _split(x[idx], rng) if len(idx) > leaf and len(normals) < most else None
        if split is None:
            here = ~leaves
            leaves += 1
        else:
            here = len(normals)
            normals.append(split[0])
            thresholds.append(split[1])
            children.append([0, 0])
            right = x[idx] @ split[0] > split[1]
            todo += [(idx[~right], here, 0), (idx[right], here, 1)]
        if parent >= 0:
            children[parent][side] = here
    width = x.shape[1]
    return (
        np.array(normals, "f4").reshape(-1, width),
        np.array(thresholds, "f4"),
        np.array(children, "i4").reshape(-1, 2),
    )


def _split(x: np.ndarray, rng: np.random.Generator) -> tuple | None:
    a, b = x[rng.choice(len(x), 2, replace=False)]
    for _ in range(3):
        side = x @ (a - b) > 0
        if side.all() or not side.any():
            break
        a, b = x[side].mean(axis=0), x[~side].mean(axis=0)
        a, b = a / (np.linalg.norm(a) + 1e-9), b / (np.linalg.norm(b) + 1e-9)
    w = a - b
    p = x @ w
    threshold = 0.0
    share = (p > threshold).mean()
    if not 0.05 <= share <= 0.95:
        threshold = float(np.median(p))
        share = (p > threshold).mean()
    return (w, threshold) if 0 < share < 1 else None


def leaves_of(tree: tuple, x: np.ndarray) -> np.ndarray:
    """The leaf of each row; one step per level for all rows together."""
    normals, thresholds, children = tree
    out = np.zeros(len(x), "i8")
    if len(normals) == 0:
        return out
    todo = [(0, np.arange(len(x)))]
    while todo:
        at, idx = todo.pop()
        if len(idx) == 0:
            continue
        if at < 0:
            out[idx] = ~at
            continue
        right = x[idx] @ normals[at] > thresholds[at]
        todo += [(int(children[at][0]), idx[~right]), (int(children[at][1]), idx[right])]
    return out


# ---------------------------------------------------------------- nodes


def sample_vectors(rows: DataFrame, width: int, n: int) -> tuple[list, np.ndarray]:
    """At most ``n`` rows, those of the smallest hashes of their ids: the same rows at every run.

    The rows are counted first, so that only those under a bar, about n in all, go to the task that orders them.
    """
    count = rows.select("id").count()
    bar = -(2**63) + int(2**64 * min(1.0, 1.1 * n / max(1, count)))
    hashed = rows.withColumn("h", F.xxhash64("id"))
    if bar < 2**63:
        hashed = hashed.where(F.col("h") < bar)
    taken = hashed.orderBy("h", "id").limit(n).select("model", "embedding").toArrow()
    emb = taken.column("embedding").combine_chunks()
    if len(emb) == 0:
        return [], np.zeros((0, width))
    flat = emb.flatten().to_numpy(zero_copy_only=False)
    x, good = unit_rows(flat, width)
    return [m for m, g in zip(taken.column("model").to_pylist(), good) if g], x


def _rows(df: DataFrame, id_col: str, model_col: str, vec_col: str, width: int) -> DataFrame:
    return df.select(
        F.col(id_col).cast("string").alias("id"),
        F.col(model_col).cast("string").alias("model"),
        F.col(vec_col).cast("array<float>").alias("embedding"),
    ).where(F.col("id").isNotNull() & F.col("model").isNotNull() & (F.size("embedding") == width))


def graph_nodes(rows: DataFrame, forest: dict, width: int, k: int) -> DataFrame:
    """(nid, id, rn, n, pack, q): of each direction the k + 1 smallest ids; n is their number.

    pack holds the node's leaf in every tree, CODE_BITS bits each; q the 16-bit vector.
    """

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            emb = b.column("embedding")
            x, good = unit_rows(emb.flatten().to_numpy(zero_copy_only=False), width)
            keep = pa.array(good)
            models = b.column("model").filter(keep)
            q = quantise(x)
            x = q.astype("f4")
            pack = np.zeros(len(x), "i8")
            names = np.array(models.to_pylist(), object)
            for m in set(names.tolist()):
                at = np.flatnonzero(names == m)
                for t, tree in enumerate(forest.get(m, [])):
                    pack[at] |= leaves_of(tree, x[at] / SCALE) << (CODE_BITS * t)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").filter(keep), models, pa.array(pack), _blobs(q)], ["id", "model", "pack", "q"]
            )

    made = rows.mapInArrow(nodes, "id string, model string, pack long, q binary")
    made = made.withColumn("nid", F.xxhash64("model", "q")).withColumn("mid", F.hash("model"))
    by_id = W.partitionBy("nid").orderBy("id")
    return (
        made.withColumn("rn", F.row_number().over(by_id))
        .where(F.col("rn") <= k + 1)
        .withColumn("n", F.count(F.lit(1)).over(W.partitionBy("nid")).cast("int"))
        .select("nid", "id", "rn", "n", "mid", "pack", F.when(F.col("rn") == 1, F.col("q")).alias("q"))
    )


# ---------------------------------------------------------------- first graph


def _best(u: np.ndarray, e: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every u its ``keep`` best edges, ordered; an edge that occurs twice counts once."""
    order = np.lexsort((e["pack"], e["v"], u))  # of an edge that occurs twice the one already followed
    u, e = u[order], e[order]
    if len(u) > 1:
        again = np.r_[False, (u[1:] == u[:-1]) & (e["v"][1:] == e["v"][:-1])]
        u, e = u[~again], e[~again]
    order = np.lexsort((e["v"], -e["s"], u))
    u, e = u[order], e[order]
    start = np.r_[True, u[1:] != u[:-1]] if len(u) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(start, np.arange(len(u)), 0)) if len(u) else np.zeros(0, "i8")
    m = np.arange(len(u)) - first < keep
    return u[m], e[m]


def _as_rows(u: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Edges sorted by u as one row for each u."""
    start = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else np.zeros(0, "i8")
    offsets = (np.r_[start, len(u)] * EDGE.itemsize).astype("<i4")
    nb = pa.Array.from_buffers(
        pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(e))]
    )
    return u[start], nb


def cell_keys(trees: int) -> list[Column]:
    """A node's cells, one a tree: model, tree and code."""
    code = (1 << CODE_BITS) - 1
    return [F.xxhash64("mid", F.lit(t), F.shiftright("pack", CODE_BITS * t).bitwiseAND(F.lit(code))) for t in range(trees)]


def part_cells(nodes: DataFrame, width: int, cell_rows: int, trees: int, seed: int = 11) -> DataFrame:
    """``nodes`` with the parts of cells of more than ``cell_rows`` rows in their pack.

    The rows of a large cell pass in the order of their hashes; the first ``PART_SAMPLE`` fit its tree, which
    parts them and all others. No task holds more of a cell than that.
    """
    keys = cell_keys(trees)
    code = lambda t: F.shiftright("pack", CODE_BITS * t).bitwiseAND(F.lit((1 << CODE_BITS) - 1))
    tagged = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), key.alias("cell"), code(t).alias("code")) for t, key in enumerate(keys)]))
    sizes = nodes.select(tagged.alias("c")).groupBy("c.cell").agg(F.count(F.lit(1)).alias("rows"))
    large = cut(sizes.where(F.col("rows") > cell_rows), "knn-large")
    if large.isEmpty():
        drop(large)
        return nodes

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, ways, rows, held = None, None, None, 0, []

        def fitted(q: np.ndarray, cell: int, rows: int) -> tuple:
            x = unit_rows(q[:PART_SAMPLE], width)[0].astype("f4")
            # half of what a cell may hold, as parts differ in size
            leaf = max(8, int(len(x) * cell_rows / (2 * rows)))
            made = _build_tree(x, leaf, np.random.default_rng([seed, cell & 0xFFFFFFFF]), PARTS)
            counts = np.bincount(leaves_of(made, x), minlength=len(made[0]) + 1)
            # a leaf that no hyperplane parts is dealt out by hash
            deal = np.maximum(1, np.ceil(counts * rows / len(x) / (2 * cell_rows)).astype("i8"))
            return made, deal

        def placed(t: np.ndarray, nid: np.ndarray, old: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
            at = leaves_of(tree, unit_rows(q, width)[0].astype("f4"))
            first = np.r_[0, np.cumsum(ways)[:-1]]
            part = 1 + first[at] + nid % ways[at]
            # a code that two cells share makes one cell of them, which loses nothing
            new = ((old << 32 | part).astype("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CODE_BITS)
            return pa.RecordBatch.from_arrays([pa.array(nid), pa.array((new.astype("i8") ^ old) << (CODE_BITS * t))], ["nid", "change"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal tree, ways, held
            if held:
                t, nid, old, q = (np.concatenate(c) for c in zip(*held))
                if tree is None:
                    tree, ways = fitted(q, now, rows)
                held = []
                yield placed(t, nid, old, q)

        for b in batches:
            if b.num_rows == 0:
                continue
            cell, t, nid, old, n = (b.column(c).to_numpy() for c in ("cell", "t", "nid", "code", "rows"))
            q = np.frombuffer(_bytes_of(b.column("q")), "<i2").reshape(-1, width)
            cuts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            for lo, hi in zip(cuts, np.r_[cuts[1:], len(cell)]):
                if now != cell[lo]:
                    yield from flush()
                    now, tree, ways, rows = int(cell[lo]), None, None, int(n[lo])
                held.append((t[lo:hi].astype("i8"), nid[lo:hi], old[lo:hi], q[lo:hi]))
                if tree is not None or sum(len(h[1]) for h in held) >= PART_SAMPLE:
                    yield from flush()
        yield from flush()

    rows = nodes.select("nid", "q", tagged.alias("c")).select("nid", "q", "c.t", "c.cell", "c.code").join(large, "cell")
    sorted_rows = rows.repartition("cell").sortWithinPartitions("cell", F.xxhash64("nid"), "nid").select("cell", "t", "nid", "code", "rows", "q")
    added = sorted_rows.mapInArrow(parts, "nid long, change long").groupBy("nid").agg(F.bit_xor("change").alias("change"))
    parted = nodes.join(added, "nid", "left").withColumn("pack", F.col("pack").bitwiseXOR(F.coalesce("change", F.lit(0)))).drop("change")
    out = cut(parted, "knn-parted", "nid")
    drop(large)
    return out


def cell_graph(cells: DataFrame, width: int, keep: int) -> DataFrame:
    """(u, pack, n, nb): the best neighbours of every node inside each of its cells, exactly."""

    def knn(table: pa.Table) -> pa.Table:
        nid, pack, n = (table.column(c).to_numpy() for c in ("nid", "pack", "n"))
        x = from_blobs(table.column("q"), width)
        k = min(keep, len(nid) - 1)
        us, es = [], []
        for lo in range(0, len(nid) if k else 0, BLOCK):
            here = np.arange(lo, min(lo + BLOCK, len(nid)))
            s = x[here] @ x.T
            s[np.arange(len(here)), here] = -2
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            e = np.empty(best.size, EDGE)
            e["v"], e["pack"], e["s"], e["n"] = nid[best].ravel(), pack[best].ravel() | FRESH, np.take_along_axis(s, best, 1).ravel(), n[best].ravel()
            us.append(np.repeat(nid[here], k))
            es.append(e)
        u, e = (np.concatenate(us), np.concatenate(es)) if us else (np.zeros(0, "i8"), np.zeros(0, EDGE))
        u, e = _best(u, e, keep)
        u, nb = _as_rows(u, e)
        order = np.argsort(nid)
        at = order[np.searchsorted(nid, u, sorter=order)] if len(u) else np.zeros(0, "i8")
        return pa.table({"u": pa.array(u, pa.int64()), "pack": pa.array(pack[at], pa.int64()), "n": pa.array(n[at], pa.int32()), "nb": nb})

    return cells.groupBy("cell").applyInArrow(knn, GRAPH)


def _edges(nb: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All edges of a column of lists, and the number of edges of each list."""
    if len(nb) == 0:
        return np.zeros(0, EDGE), np.zeros(0, "i8")
    offsets = np.frombuffer(nb.buffers()[1], "<i4")[nb.offset : nb.offset + len(nb) + 1]
    return np.frombuffer(_bytes_of(nb), EDGE), np.diff(offsets) // EDGE.itemsize


def first_graph(lists: DataFrame, keep: int) -> DataFrame:
    """One row a node with the best edges of all its cells."""
    gathered = lists.groupBy("u").agg(F.first("pack").alias("pack"), F.first("n").alias("n"), F.collect_list("nb").alias("nbs"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner = np.repeat(np.arange(b.num_rows), np.diff(b.column("nbs").offsets.to_numpy()))
            e, sizes = _edges(b.column("nbs").flatten())
            at, e = _best(np.repeat(owner, sizes), e, keep)
            at, nb = _as_rows(at, e)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at)) for c in ("u", "pack", "n")), nb], ["u", "pack", "n", "nb"])

    return gathered.mapInArrow(merge, GRAPH)


def better_graph(graph: DataFrame, found: DataFrame, keep: int) -> DataFrame:
    """The graph with the edges (u, nb) of ``found`` where they are better; only these are fresh."""
    more = found.groupBy("u").agg(F.collect_list("nb").alias("nbs"))
    both = graph.join(more, "u", "left").select("u", "pack", "n", F.concat(F.array("nb"), F.coalesce("nbs", F.array().cast("array<binary>"))).alias("nbs"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = np.diff(b.column("nbs").offsets.to_numpy())
            e, sizes = _edges(b.column("nbs").flatten())
            e = e.copy()
            old = np.zeros(len(sizes), bool)
            old[np.r_[0, np.cumsum(counts)[:-1]].astype("i8")] = True  # the first list is the node's own
            e["pack"][np.repeat(old, sizes)] &= ~FRESH
            at, e = _best(np.repeat(np.repeat(np.arange(b.num_rows), counts), sizes), e, keep)
            at, nb = _as_rows(at, e)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at)) for c in ("u", "pack", "n")), nb], ["u", "pack", "n", "nb"])

    return both.mapInArrow(merge, GRAPH)


# ---------------------------------------------------------------- descent


def new_pairs(graph: DataFrame, trees: int = TREES) -> DataFrame:
    """(lo, hi): neighbours of neighbours by at least one fresh edge that never met in a cell, each pair once, partitioned by lo."""

    def out_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e, sizes = _edges(b.column("nb"))
            u, p = (np.repeat(b.column(c).to_numpy(), sizes) for c in ("u", "pack"))
            yield pa.RecordBatch.from_arrays([pa.array(e["v"]), pa.array(u), pa.array(p | (e["pack"] & FRESH))], ["v", "u", "pack"])

    code = (1 << CODE_BITS) - 1

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e, sizes = _edges(b.column("nb"))
            u, p = (np.repeat(b.column(c).to_numpy(), sizes) for c in ("u", "pack"))
            met = (u == e["v"]) | ((p | e["pack"]) & FRESH == 0)
            for t in range(trees):
                met |= ((p ^ e["pack"]) >> (CODE_BITS * t)) & code == 0
            u, w = u[~met], e["v"][~met]
            both = np.unique(np.stack([np.minimum(u, w), np.maximum(u, w)], axis=1), axis=0) if len(u) else np.zeros((0, 2), "i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, i])) for i in (0, 1)], ["lo", "hi"])

    def siblings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e, sizes = _edges(b.column("nb"))
            after = np.cumsum(sizes)
            rest = np.repeat(after, sizes) - np.arange(len(e)) - 1  # edges of the same list behind each edge
            i = np.repeat(np.arange(len(e)), rest)
            j = np.arange(len(i)) - np.repeat(np.cumsum(rest) - rest, rest) + i + 1
            x, y = e[i], e[j]
            met = (x["pack"] | y["pack"]) & FRESH == 0
            for t in range(trees):
                met |= ((x["pack"] ^ y["pack"]) >> (CODE_BITS * t)) & code == 0
            lo, hi = np.minimum(x["v"], y["v"])[~met], np.maximum(x["v"], y["v"])[~met]
            yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], ["lo", "hi"])

    edges = graph.mapInArrow(out_edges, "v long, u long, pack long")
    middle = graph.select(F.col("u").alias("v"), "nb")
    chains = edges.join(middle, "v").select("u", "pack", "nb").mapInArrow(pairs, "lo long, hi long")
    return chains.unionByName(graph.select("nb").mapInArrow(siblings, "lo long, hi long")).repartition("lo").distinct()


def score_pairs(pairs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(u, nb) for both ends of every pair."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.einsum("ij,ij->i", from_blobs(b.column("q_lo"), width), from_blobs(b.column("q_hi"), width))
            of = {c: b.column(c).to_numpy() for c in ("lo", "hi", "p_lo", "p_hi", "n_lo", "n_hi")}
            e = np.empty(2 * len(s), EDGE)
            e["v"], e["pack"], e["s"], e["n"] = np.r_[of["hi"], of["lo"]], np.r_[of["p_hi"], of["p_lo"]] | FRESH, np.r_[s, s], np.r_[of["n_hi"], of["n_lo"]]
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[of["lo"], of["hi"]]), _blobs(e)], ["u", "nb"])

    lo = nodes.select(F.col("nid").alias("lo"), F.col("pack").alias("p_lo"), F.col("n").alias("n_lo"), F.col("q").alias("q_lo"))
    hi = nodes.select(F.col("nid").alias("hi"), F.col("pack").alias("p_hi"), F.col("n").alias("n_hi"), F.col("q").alias("q_hi"))
    return pairs.join(lo, "lo").join(hi, "hi").mapInArrow(score, "u long, nb binary")


def fresh_edges(graph: DataFrame) -> tuple[int, int]:
    """The number of edges that the descent has not followed, and of all edges."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = edges = 0
        for b in batches:
            e = _edges(b.column("nb"))[0]
            fresh, edges = fresh + int(np.count_nonzero(e["pack"] & FRESH)), edges + len(e)
        yield pa.RecordBatch.from_arrays([pa.array([fresh], pa.int64()), pa.array([edges], pa.int64())], ["fresh", "edges"])

    return tuple(graph.select("nb").mapInArrow(count, "fresh long, edges long").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("fresh", "edges")]).first())


def build_graph(
    df: DataFrame,
    k: int = 5,
    id_col: str = "id",
    model_col: str = "embedding_model",
    vec_col: str = "embedding",
    width: int = 64,
    trees: int = TREES,
    keep: int | None = None,
    sample: int = 24_000,
    leaf: int = 64,
    cell_rows: int = 4_000,
    delta: float = 0.02,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, graph): the tables of the index. Nodes as graph_nodes(); graph has (u, pack, n, nb), k + 1 edges a node, twice as many where cells are parted.

    sample: rows on which the forest is fitted (all rows are indexed). The descent goes on, however many rounds
    it takes, until one changes less than ``delta`` of the edges; lists only get better, so it ends.
    """
    if trees > TREES:
        raise ValueError(f"a node's pack holds {TREES} trees at most")
    keep = keep or k + 1
    rows = _rows(df, id_col, model_col, vec_col, width)
    models, x = sample_vectors(rows, width, sample)
    forest = build_forest(models, x, trees, leaf)
    heads = cut(graph_nodes(rows, forest, width, k), "knn-nodes", "nid")
    whole = heads.where(F.col("rn") == 1).drop("id", "rn")
    nodes = part_cells(whole, width, cell_rows, trees)
    if nodes is not whole:
        keep *= 2  # across parts the descent has all the work, and longer lists lead further
    cells = nodes.select("nid", "pack", "n", "q", F.explode(F.array(*cell_keys(trees))).alias("cell"))
    graph = cut(first_graph(cell_graph(cells, width, keep), keep), "knn-graph", "u")
    fresh, edges = fresh_edges(graph)
    while fresh > delta * edges:
        better = cut(better_graph(graph, score_pairs(new_pairs(graph, trees), nodes, width), keep), "knn-graph", "u")
        drop(graph)
        graph = better
        fresh, edges = fresh_edges(graph)
    if nodes is not whole:
        drop(nodes)
    return heads, graph


# ---------------------------------------------------------------- results


def edges_of(graph: DataFrame) -> DataFrame:
    """(u, n_u, v, n_v, sim, place, before): the graph's edges one a row; place counts from 1, before the ids of better neighbours."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e, sizes = _edges(b.column("nb"))
            start = np.repeat(np.r_[0, np.cumsum(sizes)[:-1]].astype("i8"), sizes) if len(sizes) else np.zeros(0, "i8")
            total = np.r_[0, np.cumsum(e["n"].astype("i8"))]
            u, n = (np.repeat(b.column(c).to_numpy(), sizes) for c in ("u", "n"))
            columns = [u, n, e["v"], e["n"].astype("i4"), e["s"].astype("f8"), (np.arange(len(e)) - start + 1).astype("i4"), (total[:-1] - total[start]).astype("i4")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["u", "n_u", "v", "n_v", "sim", "place", "before"])

    return graph.mapInArrow(rows, "u long, n_u int, v long, n_v int, sim double, place int, before int")


def similar_pairs(
    df: DataFrame,
    k: int = 5,
    id_col: str = "id",
    model_col: str = "embedding_model",
    vec_col: str = "embedding",
    width: int = 64,
    **options,
) -> DataFrame:
    """(chunk_a, chunk_b): every pair of ids of which one is among the k most similar of the other.

    Usable are rows with id and model whose vector has ``width`` finite numbers, not all zero; all others
    have no pairs. Copies of a vector are each other's first neighbours, smaller ids first. An empty
    table gives no rows. Extra columns are ignored.
    """
    heads, graph = build_graph(df, k, id_col, model_col, vec_col, width, **options)
    edges = edges_of(graph).where(F.col("place") <= k)
    edges = (
        edges.withColumn("take", F.least(F.col("n_v"), F.lit(k + 1) - F.col("n_u") - F.col("before")))
        .where(F.col("take") > 0)
        .select(
            F.least("u", "v").alias("lo"),
            F.greatest("u", "v").alias("hi"),
            F.when(F.col("u") < F.col("v"), F.col("take")).alias("of_hi"),
            F.when(F.col("u") > F.col("v"), F.col("take")).alias("of_lo"),
        )
        .repartition("lo")
        .groupBy("lo", "hi")
        .agg(F.coalesce(F.max("of_hi"), F.lit(0)).alias("of_hi"), F.coalesce(F.max("of_lo"), F.lit(0)).alias("of_lo"))
    )
    a = heads.select(F.col("nid").alias("lo"), F.col("id").alias("id_lo"), F.col("rn").alias("rn_lo"))
    b = heads.select(F.col("nid").alias("hi"), F.col("id").alias("id_hi"), F.col("rn").alias("rn_hi"))
    across = (
        edges.join(a, "lo")
        .join(b, "hi")
        .where((F.col("rn_hi") <= F.col("of_hi")) | (F.col("rn_lo") <= F.col("of_lo")))
        .select("id_lo", "id_hi")
    )
    many = heads.where(F.col("n") > 1)
    x = many.select("nid", F.col("id").alias("id_lo"), F.col("rn").alias("rn_lo"))
    y = many.select("nid", F.col("id").alias("id_hi"), F.col("rn").alias("rn_hi"))
    # of the ids of one direction, the k smallest others are the neighbours of each
    within = x.join(y, "nid").where((F.col("rn_lo") < F.col("rn_hi")) & (F.col("rn_lo") <= k)).select("id_lo", "id_hi")
    pairs = across.unionByName(within)
    full = many.where(F.col("rn") == k + 1).select("nid", F.col("id").alias("last"))
    if full.limit(1).count():
        pairs = pairs.unionByName(_tails(df, heads, full, k, id_col, model_col, vec_col, width))
    return pairs.select(F.least("id_lo", "id_hi").alias("chunk_a"), F.greatest("id_lo", "id_hi").alias("chunk_b"))


def _tails(df: DataFrame, heads: DataFrame, full: DataFrame, k: int, id_col: str, model_col: str, vec_col: str, width: int) -> DataFrame:
    """Pairs of the copies beyond the k + 1 smallest ids of their direction."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, good = unit_rows(b.column("embedding").flatten().to_numpy(zero_copy_only=False), width)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([b.column("id").filter(keep), b.column("model").filter(keep), _blobs(quantise(x))], ["id", "model", "q"])

    made = _rows(df, id_col, model_col, vec_col, width).mapInArrow(nodes, "id string, model string, q binary")
    rest = made.select("id", F.xxhash64("model", "q").alias("nid")).join(full, "nid").where(F.col("id") > F.col("last"))
    first = heads.where(F.col("rn") <= k).select("nid", F.col("id").alias("id_lo")).join(full.select("nid"), "nid", "left_semi")
    return rest.join(first, "nid").select("id_lo", F.col("id").alias("id_hi"))


# ---------------------------------------------------------------- search


def search(
    queries: DataFrame,
    df: DataFrame,
    heads: DataFrame,
    graph: DataFrame,
    k: int = 5,
    id_col: str = "id",
    model_col: str = "embedding_model",
    vec_col: str = "embedding",
    width: int = 64,
    sample: int = 24_000,
    leaf: int = 64,
    trees: int = TREES,
    beam: int = 12,
    starts: int = 24,
) -> DataFrame:
    """(query, id, sim): greedy search of the graph of ``df`` for vectors that need not be in it.

    A query starts at ``starts`` nodes of its own cells, then goes on from its best ``beam`` nodes to their
    neighbours, all queries together in one join a hop, until no query's best nodes change. Of copies the
    smallest ids come first. Unusable queries have no rows.
    """
    rows = _rows(df, id_col, model_col, vec_col, width)
    models, x = sample_vectors(rows, width, sample)
    forest = build_forest(models, x, trees, leaf)
    q = graph_nodes(_rows(queries, id_col, model_col, vec_col, width), forest, width, 1 << 30)
    first = q.where(F.col("rn") == 1).select(F.col("nid").alias("qn"), "mid", F.col("pack").alias("qp"), F.col("q").alias("qq"))
    first = cut(first, "knn-queries")
    nodes = heads.where(F.col("rn") == 1).select("nid", "mid", "pack", "q")
    mask = (1 << CODE_BITS) - 1
    cell = lambda p: F.explode(F.array(*[F.hash("mid", F.lit(t), F.shiftright(p, CODE_BITS * t).bitwiseAND(F.lit(mask))) for t in range(trees)]))
    by_cell = W.partitionBy("cell").orderBy("nid")
    entries = nodes.select("nid", cell("pack").alias("cell")).withColumn("n", F.row_number().over(by_cell)).where(F.col("n") <= starts).select("nid", "cell")
    seen = first.select("qn", cell("qp").alias("cell")).join(entries, "cell").select("qn", "nid").distinct()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.einsum("ij,ij->i", from_blobs(b.column("qq"), width), from_blobs(b.column("q"), width)).astype("f8")
            yield pa.RecordBatch.from_arrays([b.column("qn"), b.column("nid"), pa.array(s)], ["qn", "nid", "sim"])

    def scored(pairs: DataFrame) -> DataFrame:
        return pairs.join(first.select("qn", "qq"), "qn").join(nodes.select("nid", "q"), "nid").select("qn", "nid", "qq", "q").mapInArrow(score, "qn long, nid long, sim double")

    keep = max(beam, k)
    best = W.partitionBy("qn").orderBy(F.desc("sim"), "nid")
    edges = edges_of(graph).select(F.col("u").alias("nid"), "v")
    front = cut(scored(seen).withColumn("p", F.row_number().over(best)).where(F.col("p") <= keep).select("qn", "nid", "sim", F.lit(True).alias("fresh")), "knn-front")
    while not front.where("fresh").isEmpty():
        reached = front.where("fresh").join(edges, "nid").select("qn", F.col("v").alias("nid")).distinct().join(front.select("qn", "nid"), ["qn", "nid"], "left_anti")
        both = front.withColumn("fresh", F.lit(False)).unionByName(scored(reached).withColumn("fresh", F.lit(True)))
        new = cut(both.withColumn("p", F.row_number().over(best)).where(F.col("p") <= keep).drop("p"), "knn-front")
        drop(front)
        front = new
    hits = front.join(heads.select("nid", "id", "rn"), "nid").where(F.col("rn") <= k)
    order = W.partitionBy("qn").orderBy(F.desc(F.round("sim", 6)), "id")
    hits = hits.withColumn("p", F.row_number().over(order)).where(F.col("p") <= k).select("qn", "id", "sim")
    return q.select(F.col("nid").alias("qn"), F.col("id").alias("query")).join(hits, "qn").select("query", "id", "sim")
