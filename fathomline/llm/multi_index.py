"""Approximate nearest neighbours by an inverted multi-index.

A vector is quantised by halves: each half goes to the nearest of its own centroids, and the pair of centroids is the cell of the
vector. K centroids a half give K * K cells at the cost of 2 K distances. A query orders each half's centroids by distance and
walks the pairs by the sum of both with a heap, nearest cells first, until the cells seen hold ``share`` of all entries.
What they hold is measured again on the original vectors.

Centroids and ``share`` are fitted on ``SAMPLE`` rows, chosen by hash: ``share`` is what the sample's own queries have to see
to reach ``RECALL`` of their true neighbours. On vectors that cluster it is small; on vectors without structure it is
most of the table, as no index helps there. Every row is indexed.

Entries are dealt to tiles, runs of neighbouring cells of a bounded number of entries; a cell that is larger than
a tile is dealt to several by hash of the id, so no cell, however hot, is one task. A query is sent once to each tile that
holds one of its cells. Tiles are read in a sorted stream, entries before queries: a task holds one tile and a batch of queries. Each tile
sends its k best.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components takes no part, neither does one of another length than
most of the sample; equal distances go by the smaller id; rows of equal id and vector count once; an id with several vectors is a candidate
with each, and asks with the least of them; rows of the query's own id are never its neighbours; null ids take no part; with fewer candidates
than k all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from fathomline.llm.arrowmap import tidy
from fathomline.llm.frames import partitions

#: Rows that centroids and share are fitted on, and how many of them ask.
SAMPLE, ASKING = 16_384, 256
#: Centroids of a half at most; rounds of k-means.
CENTROIDS, ROUNDS = 64, 12
#: Part of the true neighbours that the sample's queries have to find.
RECALL = 0.97
#: Entries of a tile: at most, and below which the table isn't dealt to more tasks.
TILE_MOST, TILE_LEAST = 1 << 17, 1 << 12
#: Queries, and entries of a tile, that are held against one another at once.
QUERIES_AT_ONCE, ENTRIES_AT_ONCE = 128, 1 << 13


# --- vectors ------------------------------------------------------------------------------------------------------------


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column without nulls, all of one length, in double precision; no negative zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    rows = vectors.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{vector}`").alias("v"))
    limit = F.lit(float("inf"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, : (x.shape[1] + 1) // 2], x[:, (x.shape[1] + 1) // 2 :]


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, at least 0."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def k_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centroids; one that loses all its points stays where it was."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        near = squares(x, centres).argmin(1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


# --- the index ----------------------------------------------------------------------------------------------------------


@dataclass
class Codebook:
    """Centroids of both halves, the length of vectors, and the part of all entries that a query sees."""

    first: np.ndarray
    second: np.ndarray
    length: int
    share: float

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = halves(x)
        return squares(a, self.first).argmin(1) * len(self.second) + squares(b, self.second).argmin(1)

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """Cells by the summed distance of their centroids; the multi-sequence walk over two sorted lists."""
        a, b = (squares(h, c)[0] for h, c in zip(halves(q[None]), (self.first, self.second)))
        rows, cols = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
        a, b = a.tolist(), b.tolist()
        done = [0] * len(rows)  # of each row, the pairs that have been given
        heap = [(a[rows[0]] + b[cols[0]], 0, 0)]
        while heap:
            _, i, j = heapq.heappop(heap)
            yield rows[i] * len(cols) + cols[j]
            done[i] = j + 1
            if i + 1 < len(rows) and done[i + 1] == j:
                heapq.heappush(heap, (a[rows[i + 1]] + b[cols[j]], i + 1, j))
            if j + 1 < len(cols) and (i == 0 or done[i - 1] > j + 1):
                heapq.heappush(heap, (a[rows[i]] + b[cols[j + 1]], i, j + 1))

    def visited(self, q: np.ndarray, sizes: np.ndarray) -> list[int]:
        """The cells that a query sees: the nearest that hold ``share`` of the entries."""
        least, seen, out = self.share * sizes.sum(), 0, []
        sizes = sizes.tolist()
        for cell in self.walk(q):
            if seen >= least and out:
                break
            if sizes[cell]:
                out.append(cell)
                seen += sizes[cell]
        return out


def fit(vectors: DataFrame, k: int = 10) -> Codebook | None:
    """Learns from at most SAMPLE of the rows of ``usable``; None if there are none."""
    n = vectors.count()
    mark = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30))
    rows = vectors.filter(mark < min(1.0, 2 * SAMPLE / max(n, 1)) * (1 << 30)).orderBy(mark, "id").limit(SAMPLE).select("v").collect()
    if not rows:
        return None
    sizes = Counter(len(r.v) for r in rows)
    length = max(sizes, key=lambda s: (sizes[s], s))
    x = np.array([r.v for r in rows if len(r.v) == length], np.float64)
    distinct = np.unique(x, axis=0)
    a, b = halves(distinct)
    number = max(1, min(CENTROIDS, int((len(distinct) / 4) ** 0.5)))
    book = Codebook(k_means(a, number, 1), k_means(b, number, 2), length, 1.0)
    book.share = _share(book, x, k)
    return book


def _share(book: Codebook, x: np.ndarray, k: int) -> float:
    """The part of the sample that its own queries have to see."""
    if len(x) < 20 * k:
        return 1.0
    cells = book.cells(x)
    sizes = np.bincount(cells, minlength=len(book.first) * len(book.second))
    asking = np.unique(np.linspace(0, len(x) - 1, ASKING).astype(int))
    needs = []
    for i in asking:
        far = squares(x, x[i][None])[:, 0]
        far[i] = np.inf
        order = np.fromiter(book.walk(x[i]), np.int64)
        before = np.empty(len(order))
        before[order] = np.cumsum(sizes[order]) - sizes[order]
        needs += before[cells[np.argpartition(far, k)[:k]]].tolist()
    return float(min(1.0, np.quantile(needs, RECALL) / len(x) + 1 / len(x)))


# --- search -------------------------------------------------------------------------------------------------------------


def search(spark: SparkSession, vectors: DataFrame, asks: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest of each row whose id ``asks`` (a condition on column id) picks: query_id, rank, vec_id, score."""
    rows = usable(vectors, vec_id, vector)
    kind = rows.schema["id"].dataType
    result = StructType([StructField("query_id", kind), StructField("vec_id", kind), StructField("score", DoubleType())])
    book = fit(rows, k)
    if book is None:
        return spark.createDataFrame([], StructType([result[0], StructField("rank", IntegerType()), *result.fields[1:]]))
    rows = rows.filter(F.size("v") == book.length)
    sizes = _sizes(rows, book)
    tile_of = _Tiles(sizes, partitions(spark))
    entries = _entries(rows, book, tile_of)
    queries = _queries(rows.filter(asks).groupBy("id").agg(F.min("v").alias("v")), book, sizes, tile_of)
    met = entries.unionByName(queries).repartition(partitions(spark), "tile").sortWithinPartitions("tile", "asks")
    found = met.mapInArrow(tidy(_tile_search(to_arrow_schema(result), k, len(sizes))), result)
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _sizes(rows: DataFrame, book: Codebook) -> np.ndarray:
    """The entries of each cell; K * K sums."""

    def run(batches):
        total = np.zeros(len(book.first) * len(book.second), np.int64)
        for batch in batches:
            total += np.bincount(book.cells(matrix(batch.column(0))), minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], names=["cell", "n"])

    counted = rows.select("v").mapInArrow(tidy(run), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    sizes = np.zeros(len(book.first) * len(book.second), np.int64)
    for r in counted:
        sizes[r.cell] = r.n
    return sizes


class _Tiles:
    """Which tiles hold a cell: entries in order of cells, cut at equal numbers."""

    def __init__(self, sizes: np.ndarray, tasks: int):
        total = int(sizes.sum())
        self.number = max(1, -(-total // TILE_MOST), min(tasks, -(-total // TILE_LEAST)))
        width = total / self.number
        ends = np.cumsum(sizes)
        self.first = np.minimum((ends - sizes) / width, self.number - 1).astype(np.int64)
        self.count = np.minimum(np.maximum(ends - 1, 0) / width, self.number - 1).astype(np.int64) - self.first + 1

    def of(self, cells: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The tile of each entry; a cell that spans several deals its entries by hash."""
        return self.first[cells] + hashes % self.count[cells]


def _entries(rows: DataFrame, book: Codebook, tiles: _Tiles) -> DataFrame:
    kinds = rows.schema
    schema = StructType([StructField("tile", IntegerType()), StructField("asks", IntegerType()), kinds["id"], kinds["v"], StructField("cells", ArrayType(IntegerType()))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            cells = book.cells(matrix(batch.column(1)))
            tile = tiles.of(cells, batch.column(2).to_numpy()).astype(np.int32)
            one = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32)), pa.array(cells.astype(np.int32)))
            yield _typed([pa.array(tile), pa.array(np.zeros(len(cells), np.int32)), batch.column(0), batch.column(1), one], arrow)

    return rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit((1 << 31) - 1)).alias("hash")).mapInArrow(tidy(run), schema)


def _queries(rows: DataFrame, book: Codebook, sizes: np.ndarray, tiles: _Tiles) -> DataFrame:
    """A row for each query and tile that it sees something of, with the cells there."""
    kinds = rows.schema
    schema = StructType([StructField("tile", IntegerType()), StructField("asks", IntegerType()), kinds["id"], kinds["v"], StructField("cells", ArrayType(IntegerType()))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for i, q in enumerate(matrix(batch.column(1))):
                seen = np.array(book.visited(q, sizes))
                count = tiles.count[seen]
                tile = np.repeat(tiles.first[seen], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                cell = np.repeat(seen, count)
                order = np.argsort(tile, kind="stable")
                which, begins = np.unique(tile[order], return_index=True)
                cells = pa.ListArray.from_arrays(pa.array(np.append(begins, len(order)).astype(np.int32)), pa.array(cell[order].astype(np.int32)))
                own = pa.array(np.full(len(which), i))
                yield _typed([pa.array(which.astype(np.int32)), pa.array(np.ones(len(which), np.int32)), batch.column(0).take(own), batch.column(1).take(own), cells], arrow)

    return rows.mapInArrow(tidy(run), schema)


def _typed(columns: list, arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)


class Tile:
    """The entries of a tile by cell, each distinct vector with its least ids."""

    def __init__(self, batches: list[pa.RecordBatch], k: int):
        ids = pa.chunked_array([b.column(2) for b in batches]).combine_chunks()
        x = np.concatenate([matrix(b.column(3)) for b in batches])
        cells = np.concatenate([b.column(4).flatten().to_numpy() for b in batches])
        order = np.array(pc.sort_indices(ids))
        ids, x, cells = ids.take(pa.array(order)), x[order], cells[order]
        keep = least_ids(x, np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1], k + 1)
        keep = keep[np.argsort(cells[keep], kind="stable")]
        self.ids, self.x, self.cells = ids.take(pa.array(keep)), x[keep], cells[keep]
        self.norms = (self.x * self.x).sum(1)

    def nearest(self, q: np.ndarray, close: np.ndarray, k: int) -> list[tuple]:
        """The k nearest of some entries, by the distance itself."""
        far = np.sqrt(((self.x[close] - q) ** 2).sum(1))
        return heapq.nsmallest(k, zip(far.tolist(), self.ids.take(pa.array(close)).to_pylist()))


def least_ids(x: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Of rows in order of their ids' ranks, those kept: of each distinct vector its ``most`` least distinct ids."""
    mult = np.random.Generator(np.random.PCG64(5)).integers(0, 2**64, x.shape[1], dtype=np.uint64) | np.uint64(1)
    key = (np.ascontiguousarray(x).view(np.uint64) * mult).sum(1, dtype=np.uint64)
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), bool)  # a group is a run of one vector
    new[1:] = (key[order][1:] != key[order][:-1]) | (x[order][1:] != x[order][:-1]).any(1)
    fresh = new.copy()
    fresh[1:] |= ids[order][1:] != ids[order][:-1]
    rank = np.cumsum(fresh)
    starts = np.flatnonzero(new)
    rank -= np.repeat(rank[starts] - 1, np.diff(np.append(starts, len(order))))
    return np.sort(order[fresh & (rank <= most)])


def _tile_search(arrow: pa.Schema, k: int, n_cells: int):
    """Reads tiles one after another: all entries of a tile, then its queries."""

    def run(batches):
        now, waiting, tile = None, [], None
        for batch in batches:
            tiles, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(tiles) != 0) | (np.diff(asks) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if b == a:
                    continue
                if tiles[a] != now:
                    now, waiting, tile = tiles[a], [], None
                if not asks[a]:
                    waiting.append(batch.slice(a, b - a))
                elif waiting or tile:
                    if waiting:
                        tile, waiting = Tile(waiting, k), []
                    for at in range(a, b, QUERIES_AT_ONCE):
                        yield _answers(tile, batch.slice(at, min(QUERIES_AT_ONCE, b - at)), arrow, k, n_cells)

    return run


def _answers(tile: Tile, queries: pa.RecordBatch, arrow: pa.Schema, k: int, n_cells: int) -> pa.RecordBatch:
    """Each query's k nearest of the entries of its cells in the tile.

    Distances by a product of matrices choose what may be among the nearest, with room for their rounding;
    the distance that is returned is measured vector by vector.
    """
    x = matrix(queries.column(3))
    sees = np.zeros((len(x), n_cells), bool)
    own = []  # entries of the query's own id
    for i in range(len(x)):
        sees[i, queries.column(4)[i].values.to_numpy()] = True
        own.append(np.flatnonzero(pc.equal(tile.ids, queries.column(2)[i]).to_numpy(zero_copy_only=False)))
    norms = (x * x).sum(1)
    best: list[np.ndarray] = [np.zeros(0, np.int64)] * len(x)
    near: list[np.ndarray] = [np.zeros(0)] * len(x)
    for a in range(0, len(tile.x), ENTRIES_AT_ONCE):
        some = slice(a, a + ENTRIES_AT_ONCE)
        far = norms[:, None] + tile.norms[some] - 2 * x @ tile.x[some].T
        far[~sees[:, tile.cells[some]]] = np.inf
        slack = 1e-9 * (norms + tile.norms[some].max())
        for i in range(len(x)):
            far[i, own[i][(own[i] >= a) & (own[i] < a + far.shape[1])] - a] = np.inf
            every = np.concatenate([near[i], far[i]])
            most = np.partition(every, k - 1)[k - 1] if len(every) > k else np.inf
            pick = np.flatnonzero((every <= most + slack[i]) & (every < np.inf))
            old = len(near[i])
            best[i] = np.where(pick < old, best[i][np.minimum(pick, max(old - 1, 0))] if old else 0, pick - old + a)
            near[i] = every[pick]
    rows = [{"query_id": who, "vec_id": i, "score": d} for j, who in enumerate(queries.column(2).to_pylist()) for d, i in tile.nearest(x[j], best[j], k)]
    return pa.RecordBatch.from_pylist(rows, schema=arrow)
