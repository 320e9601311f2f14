"""Approximate nearest neighbours with vantage-point trees per shard.

Vectors are scaled to length one, where the Euclidean distance orders as the cosine does and obeys the triangle inequality.
Shards are cut by locality: a cell holds the vectors that are nearest to one of the pivots (drawn from a sample of ``SAMPLE`` vectors of
each length), and a cell of over ``SHARD_ROWS`` vectors is parted further by a hash of the id, so that no shard grows with a hot place. Each shard gets one
tree: a node parts its vectors at the median distance from a vantage point, a leaf is scanned. Queries go down a tree together, each
into its near side first; the far side is left out if it can't hold anything nearer than the k-th found, by the triangle inequality.

The k-th distance within the sample bounds a query's k-th distance from the start. By the same inequality, from the range of distances that a
cell has from its pivot, a query is sent to those cells alone that can hold something as near. The bounds are relaxed by ``factor``: with
factor one the search is exact, above one a side or a cell is also left out if ``factor`` times its least distance is beyond the k-th found.

A vector moves once, to its shard; what is sent several times are queries, once for each cell they have to see. Within a task the rows come sorted,
vectors before queries, so that the tree is built once and queries stream past it batch by batch. Where vectors are spread evenly in many dimensions
no bound leaves anything out, and every query sees every cell.

Scores are recomputed in double precision from the original vectors. Copies, and vectors that differ by a power of two, are one point with the ids
that can matter; if other points tie with the k-th within rounding, all of them are scored.

Defined results: vectors that are null, zero, empty or hold a null or a non-finite component take no part, neither do rows with null id; vectors of another
length than the query's are no candidates. Ties go to the smaller id. Rows equal in id are one candidate, with the best of their scores, but never of
the row's own id. With no candidates a query gives no rows. Other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

NEAREST = 5
#: Relaxation of the pruning; 1 is exact.
FACTOR = 2.5
LEAF = 256
#: Vectors in a shard, about; and cells at least and at most for each length of vectors.
SHARD_ROWS = 65_536
LEAST_CELLS, MOST_CELLS = 64, 1024
#: Vectors of each length from which pivots and first bounds are taken.
SAMPLE = 4096
#: Lengths of vectors that have cells; shards of others are cut by the hash alone.
MOST_LENGTHS = 16
#: Rounding of distances that pruning and the recheck allow for.
_SLACK = 1e-7
#: Candidates kept beyond the k-th, to see whether others tie with it.
_MORE = 11
_ROWS = "shard string, kind int, id long, v array<double>, bound double"
_FOUND = "query_id long, vec_id long, score double"


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def unit_of(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # neither overflows nor underflows
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class VantageTree:
    """A vantage-point tree over unit vectors, and its search for many queries at once. ``computed`` counts distances."""

    def __init__(self, unit: np.ndarray, leaf: int = LEAF, seed: int = 5):
        self.unit, self.computed = unit, 0
        rng = np.random.default_rng(seed)
        #: A leaf is an array of rows; an inner node a list of its sides, its vantage point, and the range of distances on either side.
        self.nodes: list = []
        todo: list[tuple] = [(np.arange(len(unit)), None, 0)]
        while todo:
            rows, parent, side = todo.pop()
            at = len(self.nodes)
            if parent is not None:
                self.nodes[parent][side] = at
            point = unit[rows[rng.integers(len(rows))]] if len(rows) > leaf else None
            d = distance(unit[rows], point[None, :])[:, 0] if len(rows) > leaf else None
            self.computed += len(rows) if len(rows) > leaf else 0
            inside = d <= np.median(d) if d is not None else None
            if inside is None or inside.all():
                self.nodes.append(rows)
                continue
            self.nodes.append([None, None, point, d[inside].min(), d[inside].max(), d[~inside].min(), d[~inside].max()])
            todo.append((rows[inside], at, 0))
            todo.append((rows[~inside], at, 1))

    def search(self, queries: np.ndarray, k: int, factor: float, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of the k nearest of each query; -1 where there are fewer within ``bound``, if given."""
        best_d = np.full((len(queries), k), np.inf)
        if bound is not None:
            best_d[:] = bound[:, None] + _SLACK
        best = np.full((len(queries), k), -1, np.int64)
        if len(self.unit) and len(queries):
            self._visit(0, np.arange(len(queries)), queries, factor, best_d, best)
        return best, best_d

    def _visit(self, at: int, active: np.ndarray, queries, factor, best_d, best) -> None:
        node = self.nodes[at]
        if not isinstance(node, list):
            for lo in range(0, len(node), 2048):
                rows = node[lo : lo + 2048]
                for i in range(0, len(active), 1024):
                    self._scan(rows, active[i : i + 1024], queries, best_d, best)
            return
        left, right, point, in_min, in_max, out_min, out_max = node
        d = distance(queries[active], point[None, :])[:, 0]
        self.computed += len(active)
        near = d <= (in_max + out_min) / 2
        for first, second, who, dist, own, other in ((left, right, active[near], d[near], (in_min, in_max), (out_min, out_max)), (right, left, active[~near], d[~near], (out_min, out_max), (in_min, in_max))):
            for side, (lo, hi) in ((first, own), (second, other)):
                gap = np.maximum(np.maximum(lo - dist, dist - hi), 0)  # no vector of that side is nearer, by the triangle inequality
                go = gap * factor <= best_d[who, -1] + _SLACK
                if go.any():
                    self._visit(side, who[go], queries, factor, best_d, best)

    def _scan(self, rows, who, queries, best_d, best) -> None:
        d = distance(queries[who], self.unit[rows])
        self.computed += d.size
        better = (d < best_d[who, -1:]).any(axis=1)
        who, d, k = who[better], d[better], best.shape[1]
        if not len(who):
            return
        every_d = np.concatenate((best_d[who], d), axis=1)
        every = np.concatenate((best[who], np.broadcast_to(rows, d.shape)), axis=1)
        order = np.argpartition(every_d, k - 1, axis=1)[:, :k]
        order = np.take_along_axis(order, np.argsort(np.take_along_axis(every_d, order, axis=1), axis=1), axis=1)
        best_d[who], best[who] = np.take_along_axis(every_d, order, axis=1), np.take_along_axis(every, order, axis=1)

    def within(self, query: np.ndarray, radius: float, factor: float) -> np.ndarray:
        """All rows at most ``radius`` away from one query."""
        todo, out = [0], [np.zeros(0, np.int64)]
        while todo:
            node = self.nodes[todo.pop()]
            if not isinstance(node, list):
                d = distance(query[None, :], self.unit[node])[0]
                self.computed += len(node)
                out.append(node[d <= radius])
                continue
            left, right, point, in_min, in_max, out_min, out_max = node
            d = distance(query[None, :], point[None, :])[0, 0]
            self.computed += 1
            todo += [side for side, lo, hi in ((left, in_min, in_max), (right, out_min, out_max)) if max(lo - d, d - hi, 0) * factor <= radius]
        return np.concatenate(out)


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


class Shard:
    """The points of a shard, their ids, and their tree."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], v[order]
        # copies and multiples by a power of two have the same digits, and the same cosines to the last bit
        digits = np.ascontiguousarray(np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])) + 0.0
        _, first, point = np.unique(digits.view(f"V{v.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
        members = np.argsort(point, kind="stable")  # by point, then by id
        begin = np.searchsorted(point[members], np.arange(len(first)))
        self.k, self.points, self.begin, self.ids = k, v[first], begin, ids[members]
        self.many = np.minimum(np.diff(np.append(begin, len(ids))), k + 1)  # of the ids of a point, the k + 1 smallest can matter
        self.tree = VantageTree(unit_of(self.points))

    def search(self, own: np.ndarray, q: np.ndarray, factor: float, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, id, score) of the k nearest of each query."""
        k, unit = self.k, unit_of(q)
        found, d = self.tree.search(unit, k + 1 + _MORE, factor, bound)
        a, b = np.nonzero(found >= 0)
        point = found[a, b]
        # where the last one kept may tie with the k + 1st, others may, too
        tied = np.flatnonzero((found[:, -1] >= 0) & (d[:, -1] <= d[:, k] + _SLACK))
        if len(tied):
            more = [self.tree.within(unit[i], d[i, k] + _SLACK, factor) for i in tied]
            rest = ~np.isin(a, tied)
            a, point = np.concatenate((a[rest], np.repeat(tied, [len(m) for m in more]))), np.concatenate((point[rest], *more))
        score = _cosine(q[a], self.points[point])
        n = self.many[point]
        at = np.repeat(self.begin[point], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a, score, near = np.repeat(a, n), np.repeat(score, n), self.ids[at]
        other = near != own[a]
        a, score, near = a[other], score[other], near[other]
        order = np.lexsort((near, -score, a))
        a, score, near = a[order], score[order], near[order]
        keep = np.arange(len(a)) - np.searchsorted(a, a) < k
        return own[a[keep]], near[keep], score[keep]


def _vectors(column) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


class Cells:
    """Pivots of each length of vectors, with the sample that bounds a query's k-th distance."""

    def __init__(self, sample: dict[int, np.ndarray], cells: dict[int, int], k: int, ids: dict[int, np.ndarray] | None = None):
        self.unit = {dim: unit_of(v) for dim, v in sample.items()}
        self.sample, self.ids = sample, ids or {}
        self.k, self.pivots = k, {}
        for dim, u in self.unit.items():
            # far from each other first, then the means of what is nearest to each
            chosen, d = [0], distance(u, u[:1])[:, 0]
            while len(chosen) < min(cells[dim], len(u)) and d.max() > 1e-6:
                chosen.append(int(np.argmax(d)))
                d = np.minimum(d, distance(u, u[chosen[-1:]])[:, 0])
            pivots = u[chosen]
            for _ in range(3):
                nearest = distance(u, pivots).argmin(axis=1)
                mean = np.stack([u[nearest == i].sum(axis=0) if (nearest == i).any() else p for i, p in enumerate(pivots)])
                norm = np.linalg.norm(mean, axis=1, keepdims=True)
                pivots = np.where(norm > 1e-9, mean / np.maximum(norm, 1e-9), pivots)
            self.pivots[dim] = pivots

    def place(self, dim: int, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector and its distance from the pivot."""
        if dim not in self.pivots:
            return np.zeros(len(v), np.int64), np.zeros(len(v))
        d = distance(unit_of(v), self.pivots[dim])
        cell = d.argmin(axis=1)
        return cell, d[np.arange(len(v)), cell]

    def bounds(self, dim: int, v: np.ndarray) -> np.ndarray:
        """An upper bound of each query's distance to its k-th other vector."""
        u = self.unit.get(dim)
        if u is None or len(u) <= self.k:
            return np.full(len(v), np.inf)
        return np.partition(distance(unit_of(v), u), self.k, axis=1)[:, self.k]  # one of the sample can be the query's own


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, dim) of the rows that take part."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    return rows.where(F.coalesce(ok, F.lit(False)) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def _sampled(cells: Cells):
    """What each query finds in the sample, so that a query with k candidates gets k, however much the relaxed bounds leave out."""

    def run(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                if int(dim) not in cells.ids:
                    continue
                at = np.flatnonzero(dims == dim)
                own, sample = cells.ids[int(dim)], cells.sample[int(dim)]
                for i in range(0, len(at), 512):
                    part = pa.array(at[i : i + 512])
                    ids, v = batch.column(0).take(part).to_numpy(), _vectors(batch.column(1).take(part))
                    d = distance(unit_of(v), cells.unit[int(dim)])
                    d[ids[:, None] == own[None, :]] = np.inf
                    n = min(cells.k, len(own))
                    best = np.argpartition(d, n - 1, axis=1)[:, :n]
                    q, c = np.nonzero(np.isfinite(np.take_along_axis(d, best, axis=1)))
                    c = best[q, c]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(own[c]), pa.array(_cosine(v[q], sample[c]))], names=["query_id", "vec_id", "score"])

    return run


def _placed(cells: Cells):
    """(id, v, dim) to the same with cell and distance from the pivot."""

    def run(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            cell, away = np.zeros(len(dims), np.int64), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for i in range(0, len(at), 4096):
                    part = at[i : i + 4096]
                    cell[part], away[part] = cells.place(int(dim), _vectors(batch.column(1).take(pa.array(part))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], names=["id", "v", "dim", "cell", "away"])

    return run


def _sent(cells: Cells, ranges: dict[int, np.ndarray], factor: float):
    """Each query once for each shard that can hold one of its k nearest."""

    def run(batches):
        for batch in batches:
            ids, dims = batch.column(0), batch.column(2).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                of = ranges[int(dim)]  # rows: cell, shards, least and largest distance from the pivot
                for i in range(0, len(at), 512):
                    part = pa.array(at[i : i + 512])
                    column = batch.column(1).take(part)
                    v = _vectors(column)
                    bound = cells.bounds(int(dim), v)
                    d = distance(unit_of(v), cells.pivots[int(dim)])[:, of[:, 0].astype(int)] if int(dim) in cells.pivots else np.zeros((len(v), len(of)))
                    gap = np.maximum(np.maximum(of[:, 2] - d, d - of[:, 3]), 0)
                    q, c = np.nonzero(gap * factor <= bound[:, None] + _SLACK)
                    n = of[c, 1].astype(int)
                    names = np.array([f"{dim}-{int(of[x, 0])}-{y}" for x in range(len(of)) for y in range(int(of[x, 1]))], object)
                    start = np.cumsum(of[:, 1].astype(int)) - of[:, 1].astype(int)
                    shard = np.repeat(start[c], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    who = pa.array(np.repeat(q, n))
                    yield pa.RecordBatch.from_arrays([pa.array(names[shard], pa.string()), pa.array(np.ones(len(who), np.int32)), ids.take(part).take(who), column.take(who), pa.array(bound[np.repeat(q, n)])], names=["shard", "kind", "id", "v", "bound"])

    return run


def _search(k: int, factor: float):
    """Sorted rows of shards, vectors before queries, to what the queries find."""

    def run(batches):
        shard, held, tree = None, [], None
        for batch in batches:
            names, kinds = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            cut = np.flatnonzero(np.concatenate(([True], (names[1:] != names[:-1]) | (kinds[1:] != kinds[:-1]), [True]))) if len(names) else []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if names[a] != shard:
                    shard, held, tree = names[a], [], None
                ids, v = batch.column(2).slice(a, b - a).to_numpy(), _vectors(batch.column(3).slice(a, b - a))
                if kinds[a] == 0:
                    held.append((ids, v))
                    continue
                if tree is None and held:
                    tree = Shard(*(np.concatenate(x) for x in zip(*held, strict=True)), k)
                    held = []
                if tree is not None:
                    got = tree.search(ids, v, factor, batch.column(4).slice(a, b - a).to_numpy())
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = NEAREST, factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest by cosine of each row for which ``is_query`` (of ``id``) holds."""
    rows = materialise(usable(vectors, id_col, vec_col), "vectors")
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(MOST_LENGTHS).collect()}
    count = {dim: int(min(max(LEAST_CELLS, -(-n // SHARD_ROWS)), MOST_CELLS)) for dim, n in sizes.items()}
    sample, ids = {}, {}
    for dim in sizes:
        got = rows.where(F.col("dim") == dim).select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
        sample[dim], ids[dim] = _vectors(got.column("v").combine_chunks()), got.column("id").to_numpy()
    cells = Cells(sample, count, k, ids)
    placed = materialise(rows.mapInArrow(_placed(cells), "id long, v array<double>, dim int, cell long, away double"), "placed")
    per = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("lo"), F.max("away").alias("hi"))
    per = materialise(per.withColumn("shards", F.ceil(F.col("n") / SHARD_ROWS)), "cells")
    name = F.concat_ws("-", "dim", "cell", F.pmod(F.xxhash64("id", F.lit(1)), F.col("shards")))
    none = F.lit(None).cast("double")
    left = placed.join(F.broadcast(per.select("dim", "cell", "shards")), ["dim", "cell"]).select(name.alias("shard"), F.lit(0).alias("kind"), "id", "v", none.alias("bound"))
    ranges: dict[int, list] = {}
    for r in per.orderBy("dim", "cell").collect():  # at most MOST_CELLS a length with cells, one of any other
        ranges.setdefault(r["dim"], []).append((r["cell"], r["shards"], r["lo"], r["hi"]))
    known = {dim: np.array(x, np.float64) for dim, x in ranges.items()}
    queries = rows.where(is_query(F.col("id")))
    dealt = left.unionByName(queries.mapInArrow(_sent(cells, known, factor), _ROWS)).repartition("shard").sortWithinPartitions("shard", "kind")
    return top_of_each(dealt.mapInArrow(_search(k, factor), _FOUND).unionByName(queries.mapInArrow(_sampled(cells), _FOUND)), k)


def top_of_each(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query, by one shuffle of what each shard found: k rows a query and shard at most."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def ann_report(vectors: DataFrame, every: int = 50, **options) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``."""
    return nearest(vectors, lambda i: i % every == 0, **options)
