"""Approximate nearest neighbours: shards by a vantage-point partition, and a vantage-point tree for every shard."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_paths, drop_tables, fresh_path, quoted, shuffle_partitions, table_mark, written
from .files import NamedFile, store_of

#: Vectors in a leaf, in a shard, and queries in a block: what bounds a task's memory.
LEAF, SHARD, BLOCK = 64, 2048, 4096
#: Bytes of vectors in trees that a task holds, and blocks of queries that it reads one by one.
BUNDLE, SPAN = 64 << 20, 64
#: Bands of distance that a region with more than a shard's vectors is parted into at most, before ids are hashed.
BANDS = 32
#: Regions of the partition at most, and sampled vectors for each that it is laid out by: what bounds the driver's memory.
REGIONS, SAMPLED = 1024, 16
#: Distances and scores nearer than this are told apart by the exact score.
SLACK = 1e-9


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows, in double precision, summed in order of components: the same for the same pair wherever it is met."""
    dot, aa, bb = (np.zeros(len(a)) for _ in range(3))
    for k in range(a.shape[1]):
        x, y = a[:, k], b[:, k]
        dot, aa, bb = dot + x * y, aa + x * x, bb + y * y
    return dot / (np.sqrt(aa) * np.sqrt(bb))


class VantageTree:
    """Vectors of unit length in a binary tree: a node has a vantage point and, for both halves, the range of distances from it.

    The halves are cut by rank, so that equal vectors end like others.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, nodes: np.ndarray | None = None, order: np.ndarray | None = None):
        self.ids, self.vectors = ids, vectors
        self.units = vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))
        if nodes is None or order is None:
            self.order, made = np.arange(len(ids)), []
            self._grow(0, len(ids), made)
            self.nodes = np.array(made, np.float64).reshape(-1, 8)
        else:
            self.nodes, self.order = nodes, order

    def _grow(self, start: int, end: int, made: list) -> int:
        """Adds the node of order[start:end]: start, end, near child, far child, and the near and far ranges; leaves have no children."""
        at = len(made)
        made.append((start, end, -1, -1, 0, 0, 0, 0))
        if end - start > LEAF:
            vantage = self.order[start]
            rest = self.order[start + 1 : end]
            away = np.sqrt(np.maximum(0, 2 - 2 * self.units[rest] @ self.units[vantage]))
            rank = np.argsort(away, kind="stable")
            self.order[start + 1 : end], away = rest[rank], away[rank]
            half = len(rest) // 2
            near, far = self._grow(start + 1, start + 1 + half, made), self._grow(start + 1 + half, end, made)
            made[at] = (start, end, near, far, away[0], away[half - 1], away[half], away[-1])
        return at

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, vectors=self.vectors.astype(np.float32) if np.array_equal(self.vectors, self.vectors.astype(np.float32)) else self.vectors, nodes=self.nodes, order=self.order)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> VantageTree:
        with np.load(io.BytesIO(data)) as held:
            return cls(held["ids"], held["vectors"].astype(np.float64), held["nodes"], held["order"])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores (rows of k, nearest first, id -1 where there are fewer) of the queries' nearest vectors with another id.

        All queries of a block go down together. A half is left out for a
        query when the least distance that the triangle inequality allows in
        it, times factor, is over the distance of the query's k-th found:
        exactly so with factor 1, and the more boldly the larger it is. least:
        scores below which a query needs nothing, as it has k at them or above.
        """
        units = queries / np.sqrt((queries * queries).sum(1, keepdims=True))
        best = np.full((len(queries), k), -np.inf)
        if least is not None:
            best[:] = least[:, None]
        met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def look(rows: np.ndarray, places: np.ndarray) -> None:
            near = units[rows] @ self.units[places].T
            near[query_ids[rows, None] == self.ids[places]] = -np.inf
            row, place = np.nonzero(near >= np.maximum(best[rows, -1:] - SLACK, -2))
            met.append((rows[row], places[place], near[row, place]))
            hit = np.unique(row)
            both = np.concatenate([best[rows[hit]], near[hit]], axis=1)
            best[rows[hit]] = -np.sort(np.partition(-both, k - 1, axis=1)[:, :k], axis=1)

        def walk(node: int, rows: np.ndarray) -> None:
            start, end, near, far = self.nodes[node, :4].astype(int)
            if near < 0:
                look(rows, self.order[start:end])
                return
            look(rows, self.order[start : start + 1])
            away = np.sqrt(np.maximum(0, 2 - 2 * units[rows] @ self.units[self.order[start]]))
            near_low, near_high, far_low, far_high = self.nodes[node, 4:]
            inner = away < (near_high + far_low) / 2
            for child, low, high, mine in ((near, near_low, near_high, inner), (far, far_low, far_high, ~inner)):
                follow(child, low, high, rows[mine], away[mine])
            for child, low, high, mine in ((near, near_low, near_high, ~inner), (far, far_low, far_high, inner)):
                follow(child, low, high, rows[mine], away[mine])

        def follow(child: int, low: float, high: float, rows: np.ndarray, away: np.ndarray) -> None:
            least = np.maximum(0, np.maximum(low - away, away - high))
            kth = best[rows, -1]
            reach = np.where(np.isfinite(kth), np.sqrt(np.maximum(0, 2 - 2 * np.where(np.isfinite(kth), kth, 0))), np.inf)
            rows = rows[least * factor <= reach + 1e-6]  # distances near 0 lose half the digits
            if len(rows):
                walk(child, rows)

        if len(self.ids) and len(queries):
            walk(0, np.arange(len(queries)))
        ids, scores = np.full(best.shape, -1, np.int64), np.full(best.shape, -np.inf)
        if met:
            row, place, near = (np.concatenate(x) for x in zip(*met, strict=True))
            row, place = (x[near >= best[row, -1] - SLACK] for x in (row, place))
            score = cosine(queries[row], self.vectors[place])
            rank = np.lexsort((self.ids[place], -score, row))
            row, place, score = row[rank], place[rank], score[rank]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            first = nth < k
            ids[row[first], nth[first]], scores[row[first], nth[first]] = self.ids[place[first]], score[first]
        return ids, scores


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def usable_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector, dim): rows with an id whose vector is not null, has finite components only and is not zero.

    Rows that repeat an id count as one, with the least of their vectors.
    """
    v = F.transform(F.col(quoted(vector_col)), lambda x: x.cast("double"))
    rows = vectors.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), v.alias("vector")).filter("vec_id is not null and vector is not null")
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    one = rows.filter(finite).filter(square > 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return one.withColumn("dim", F.size("vector"))


class Partition:
    """Regions of space by vantage points: an inner node parts vectors by their distance from its point, a leaf is a region with a point of its own.

    Laid out by a sample of units (rows of unit length), cut at the middle until there are
    about `regions` leaves. Any vector belongs to one region.
    """

    def __init__(self, units: np.ndarray, regions: int):
        self.nodes: list[tuple[np.ndarray, float, int, int]] = []
        self.points: list[np.ndarray] = []
        self.root = self._part(units, regions)

    def _part(self, units: np.ndarray, regions: int) -> int:
        """The node, or for a leaf -1 - its region."""
        away = chords(units, units[:1])[:, 0] if len(units) else np.zeros(0)
        half = np.median(away) if len(away) else 0.0
        if regions < 2 or not (away <= half).any() or (away <= half).all():
            self.points.append(units[len(units) // 2])
            return -len(self.points)
        at = len(self.nodes)
        self.nodes.append((units[0], half, 0, 0))
        near, far = self._part(units[away <= half], regions // 2), self._part(units[away > half], regions - regions // 2)
        self.nodes[at] = (units[0], half, near, far)
        return at

    def regions_of(self, units: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(units), np.int64), [(self.root, np.arange(len(units)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                point, half, near, far = self.nodes[node]
                inner = chords(units[rows], point[None])[:, 0] <= half
                todo += [(near, rows[inner]), (far, rows[~inner])]
        return out


def chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors, rows of a from rows of b."""
    return np.sqrt(np.maximum(0, 2 - 2 * a @ b.T))


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def partitions(usable: DataFrame, shard_rows: int = SHARD, most: int = REGIONS) -> dict[int, Partition]:
    """A partition for every dimension, with about a region for shard_rows vectors, laid out by the vectors of least seeded hash.

    What comes to the driver is bounded by most * SAMPLED vectors in all.
    """
    regions = min(most, -(-usable.count() // shard_rows))
    sample = usable.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(regions * SAMPLED).select("dim", "vector").toPandas()
    return {int(dim): Partition(_units(_matrix(some["vector"])), max(1, round(regions * len(some) / len(sample)))) for dim, some in sample.groupby("dim")}


def _placed(usable: DataFrame, parts: dict[int, Partition]) -> DataFrame:
    """usable with the region of every vector and its distance from the region's point; dimensions that the sample has none of are one region."""

    def place(batches):
        for batch in batches:
            frame = batch.to_pandas()
            frame["region"], frame["away"] = 0, 0.0
            for dim, some in frame.groupby("dim"):
                if dim in parts:
                    units = _units(_matrix(some["vector"]))
                    regions = parts[dim].regions_of(units)
                    frame.loc[some.index, "region"] = regions
                    for region in np.unique(regions):
                        mine = regions == region
                        frame.loc[some.index[mine], "away"] = chords(units[mine], parts[dim].points[region][None])[:, 0]
            yield pa.RecordBatch.from_pandas(frame[["vec_id", "vector", "dim", "region", "away"]], preserve_index=False)

    return usable.mapInArrow(place, "vec_id long, vector array<double>, dim int, region long, away double")


def vantage_index(placed: DataFrame, parts: dict[int, Partition], shard_rows: int = SHARD) -> DataFrame:
    """Trees of all vectors: (dim, region, shard, n, low, high, tree), with the range of distances from the region's vantage point.

    A region with more than shard_rows vectors is parted into bands by the
    distance from its point, so that each shard has a narrow range; bands that
    are still larger, as with many equal vectors, are dealt out by the hash of
    the id, so that no task gets more than about as many.
    """
    cuts = F.percentile_approx("away", F.array(*[F.lit(i / BANDS) for i in range(1, BANDS)]), F.lit(1000))
    laid = written(placed.groupBy("dim", "region").agg(F.least(F.ceil(F.count("*") / shard_rows), F.lit(BANDS)).alias("bands"), cuts.alias("cuts")), "vantage-bands", 1)
    under = F.size(F.filter("cuts", lambda c: c < F.col("away")))
    banded = placed.join(laid, ["dim", "region"]).withColumn("band", F.floor(under * F.col("bands") / F.lit(BANDS)).cast("int")).select("vec_id", "vector", "dim", "region", "band")
    sizes = written(banded.groupBy("dim", "region", "band").agg(F.ceil(F.count("*") / shard_rows).alias("pieces")), "vantage-pieces", 1)
    dealt = banded.join(sizes, ["dim", "region", "band"]).withColumn("shard", (F.col("band") + BANDS * F.pmod(F.xxhash64("vec_id"), "pieces")).cast("int"))

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id")
        tree = VantageTree(frame["vec_id"].to_numpy(np.int64), _matrix(frame["vector"]))
        dim, region, shard = (int(frame[c].iloc[0]) for c in ("dim", "region", "shard"))
        away = chords(tree.units, parts[dim].points[region][None]) if dim in parts else np.array([0.0, 2.0])
        return pd.DataFrame({"dim": [dim], "region": [region], "shard": [shard], "n": [len(frame)], "low": [away.min()], "high": [away.max()], "tree": [tree.dump()]})

    return written(dealt.groupBy("dim", "region", "shard").applyInPandas(grow, "dim int, region long, shard int, n long, low double, high double, tree binary"), "vantage-trees")


def least_distances(units: np.ndarray, point: np.ndarray | None, low: np.ndarray | float, high: np.ndarray | float) -> np.ndarray:
    """The least distance from each unit vector that the triangle inequality allows anything whose distance from point is in low to high."""
    if point is None:
        return np.zeros(len(units))
    away = chords(units, point[None])[:, 0]
    return np.maximum(0, np.maximum(low - away, away - high))


def in_reach(bound: np.ndarray, least: np.ndarray, factor: float) -> np.ndarray:
    """Queries that have to look where nothing is nearer than bound: those whose k-th found (score `least`, -inf: under k found) is no nearer than bound times factor."""
    reach = np.where(np.isfinite(least), np.sqrt(np.maximum(0, 2 - 2 * np.where(np.isfinite(least), least, 0))), np.inf)
    return bound * factor <= reach + 1e-6  # distances near 0 lose half the digits


def _block_file(folder: str, dim: int, block: int) -> str:
    return f"{folder}/{dim}-{block}.npz"


def write_blocks(queries: DataFrame, ranges: dict[int, pd.DataFrame], parts: dict[int, Partition], folder: str, blocks: int) -> DataFrame:
    """Writes queries (dim, vec_id, least, vector) once, in files of a dimension and a block: ids, vectors, nearest region and score of the k-th so far.

    ranges: for each dimension the (region, low, high) of all regions.
    """

    def save(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id")
        dim, block = int(frame["dim"].iloc[0]), int(frame["block"].iloc[0])
        vectors, home, held = _matrix(frame["vector"]), np.zeros(len(frame), np.int64), ranges.get(dim)
        if dim in parts and held is not None:
            units, best = _units(vectors), np.full((len(frame), 2), np.inf)
            for region, low, high in zip(held["region"], held["low"], held["high"], strict=True):
                away = chords(units, parts[dim].points[region][None])[:, 0]
                bound = np.maximum(0, np.maximum(low - away, away - high))
                nearer = (bound < best[:, 0]) | ((bound == best[:, 0]) & (away < best[:, 1]))
                home[nearer], best[nearer, 0], best[nearer, 1] = region, bound[nearer], away[nearer]
        least = frame["least"].to_numpy(np.float64)
        file = NamedFile(_block_file(folder, dim, block))
        data = io.BytesIO()
        np.savez(data, ids=frame["vec_id"].to_numpy(np.int64), vectors=vectors, home=home, least=np.where(np.isnan(least), -np.inf, least))
        file.out.write(data.getvalue())
        file.close()
        return pd.DataFrame({"dim": [dim], "block": [block], "n": [len(frame)]})

    dealt = queries.select("dim", "vec_id", "least", "vector", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).cast("int").alias("block"))
    return written(dealt.groupBy("dim", "block").applyInPandas(save, "dim int, block int, n long"), "query-blocks")


def _read_block(folder: str, dim: int, block: int) -> tuple[np.ndarray, ...] | None:
    """What write_blocks has put into a file; None where a dimension has no queries in the block."""
    store, path = store_of(_block_file(folder, dim, block))
    if not store.get_file_info(path).is_file:
        return None
    with store.open_input_stream(path, compression=None) as raw, np.load(io.BytesIO(raw.read())) as held:
        return held["ids"], held["vectors"], held["home"], held["least"]


def search_trees(trees: list[tuple[int, float, float, VantageTree]], points: list[np.ndarray] | None, block: tuple[np.ndarray, ...], k: int, factor: float, first: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of a block's k nearest in the trees (region, low, high, tree), and how often a query was sent down a tree.

    first: queries look into the trees of their own region, else into those of
    all others; trees that a query's k-th so far rules out are left out.
    """
    names, vectors, home, least = block
    units, sent = _units(vectors), 0
    best_ids, best = np.full((len(names), k), -1, np.int64), np.full((len(names), k), -np.inf)
    for region, low, high, tree in trees:
        mine = np.flatnonzero((home == region) == first)
        bound = least_distances(units[mine], None if points is None else points[region], low, high)
        rows = mine[in_reach(bound, least[mine], factor)]
        if not len(rows):
            continue
        sent += len(rows)
        ids, scores = tree.search(names[rows], vectors[rows], k, factor, least[rows])
        ids, scores = np.concatenate([best_ids[rows], ids], axis=1), np.concatenate([best[rows], scores], axis=1)
        rank = np.lexsort((ids, -scores), axis=1)[:, :k]
        best_ids[rows], best[rows] = np.take_along_axis(ids, rank, 1), np.take_along_axis(scores, rank, 1)
        least = np.maximum(least, best[:, k - 1])
    return best_ids, best, sent


def _searched(index: DataFrame, parts: dict[int, Partition], folder: str, blocks: int, k: int, factor: float, first: bool) -> DataFrame:
    """What every query finds: query_id, vec_id, score; up to k from a bundle of trees.

    Trees are shuffled in bundles of about BUNDLE bytes, once for every SPAN
    blocks of queries; queries are not shuffled again, as each task reads the
    blocks' files one by one.
    """
    spark = index.sparkSession
    size = index.agg(F.count("*").alias("shards"), F.coalesce(F.sum(F.col("n") * F.col("dim") * 8), F.lit(0)).alias("bytes")).first()
    bundles = max(1, -(-size.bytes // BUNDLE), min(size.shards, shuffle_partitions(spark)))
    of_span = SPAN
    spans = -(-blocks // of_span)
    dealt = index.withColumn("bundle", F.pmod(F.xxhash64("region", "shard"), F.lit(bundles))).withColumn("span", F.explode(F.sequence(F.lit(0), F.lit(spans - 1))))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        dim, span = int(frame["dim"].iloc[0]), int(frame["span"].iloc[0])
        trees = [(int(region), low, high, VantageTree.load(tree)) for region, low, high, tree in zip(frame["region"], frame["low"], frame["high"], frame["tree"], strict=True)]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for number in range(span * of_span, min(blocks, (span + 1) * of_span)):
            block = _read_block(folder, dim, number)
            if block is not None:
                ids, scores, _ = search_trees(trees, parts[dim].points if dim in parts else None, block, k, factor, first)
                hit = ids >= 0
                found.append((np.repeat(block[0], k).reshape(ids.shape)[hit], ids[hit], scores[hit]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return dealt.select("dim", "bundle", "span", "region", "low", "high", "tree").groupBy("dim", "bundle", "span").applyInPandas(search, "query_id long, vec_id long, score double")


def search_index(index: DataFrame, queries: DataFrame, parts: dict[int, Partition], k: int = 5, factor: float = 1.0, block_rows: int = BLOCK) -> DataFrame:
    """The k nearest indexed vectors of every query: query_id, rank, vec_id, score.

    Queries (vec_id, vector, dim) first search the nearest region, then the
    shards of all others that the triangle inequality does not rule out by
    their k-th. The best k of all are what a query gets; ties go to the
    smaller id.
    """
    spark, mark = index.sparkSession, table_mark()
    blocks = max(1, -(-queries.count() // block_rows))
    folder = fresh_path(spark, "vantage-queries")
    found = index.groupBy("dim", "region").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim", "region").toPandas()
    ranges = {int(dim): some for dim, some in found.groupby("dim")}
    write_blocks(queries.withColumn("least", F.lit(None).cast("double")), ranges, parts, f"{folder}/first", blocks)
    near = written(_searched(index, parts, f"{folder}/first", blocks, k, factor, True), "vantage-first")
    kth = near.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores")).select(F.col("query_id").alias("vec_id"), F.get("scores", F.lit(k - 1)).alias("least"))
    write_blocks(queries.join(kth, "vec_id", "left"), ranges, parts, f"{folder}/second", blocks)
    far = _searched(index, parts, f"{folder}/second", blocks, k, factor, False)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = near.union(far).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    out = written(out, "vantage-found")
    drop_tables(spark, mark, (out,))
    drop_paths(spark, [folder])
    return out


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD, block_rows: int = BLOCK) -> DataFrame:
    """The k nearest of all other vectors, by cosine, for every vector whose id is divisible by `every`.

    Vectors that are null, zero or hold null or non-finite components take no
    part, nor do rows without an id; vectors of another dimension than the
    query's are no candidates of it; an empty table gives no rows. Where the
    triangle inequality rules out little, as in many dimensions at factor 1,
    every query meets every shard: its vector is read once for each bundle of
    shards, but shuffled only into its block.
    """
    mark = table_mark()
    usable = written(usable_vectors(vectors, id_col, vector_col), "vectors")
    parts = partitions(usable, shard_rows)
    placed = written(_placed(usable, parts), "placed-vectors")
    out = search_index(vantage_index(placed, parts, shard_rows), placed.filter(F.col("vec_id") % every == 0), parts, k, factor, block_rows)
    drop_tables(vectors.sparkSession, mark, (out,))
    return out
