"""K-means: driver rounds over a persisted frame of vectors. Only sums by cluster come to the driver."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.literals import double
from tabulon.functions.pcg import WORD, Pcg32
from tabulon.operators.base import Estimator
from tabulon.plans.features import Features
from tabulon.plans.moments import moments
from tabulon.plans.partials import added, blocks, matrix, summed

log = logging.getLogger(__name__)
#: Values (rows times features) up to which, unless told otherwise, all rounds run on one array on the driver: at most 16 MB, and no
#: jobs between rounds.
LOCAL_CELLS = 1 << 21
#: Up to so many centre coordinates, distances are SQL projections; beyond, NumPy over Arrow blocks.
SQL_CELLS = 16
#: Values of a persisted block and, about, of all blocks of a task; rows whose distances are taken together.
BLOCK_CELLS, TASK_CELLS = 1 << 18, 1 << 22
PIECE = 2048
#: Sums (runs times centres times features) that one job brings for restarts that go their rounds together.
SUMS_CELLS = 1 << 17


def squared_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Direct differences, centre by centre."""
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centers], axis=1)


def nearest_centers(x: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """For each row and run the number of the nearest centre by direct differences, the lowest of equally near ones.

    ``runs`` has a run, a centre, a feature. Products tell centres apart; where they lie too close for their rounding, direct
    differences decide.
    """
    r, k, p = runs.shape
    flat = runs.reshape(-1, p)
    squares = (flat * flat).sum(axis=1)
    score = (squares / 2 - x @ flat.T).reshape(-1, r, k)
    label = score.argmin(axis=2)
    if k > 1:
        two = np.partition(score, 1, axis=2)
        reach = np.sqrt(np.einsum("ij,ij->i", x, x)) + np.sqrt(squares.max())
        limit = 8 * (p + 4) * np.finfo(float).eps * reach * reach
        close_call = ~(two[..., 1] - two[..., 0] > limit[:, None])
        for j in np.flatnonzero(close_call.any(axis=0)):
            close = np.flatnonzero(close_call[:, j])
            label[close, j] = squared_distances(x[close], runs[j]).argmin(axis=1)
    return label


def _pieces(x: np.ndarray):
    for i in range(0, len(x), PIECE):
        yield x[i : i + PIECE]


def _sums_of(runs: np.ndarray):
    """A block's rows added up by run and nearest centre, with their number."""
    r, k, p = runs.shape

    def of(x: np.ndarray) -> np.ndarray:
        label = nearest_centers(x, runs) + np.arange(r) * k
        member = np.zeros((len(x), r * k))
        member[np.arange(len(x))[:, None], label] = 1.0
        return np.column_stack([member.T @ x, member.sum(axis=0)]).ravel()

    return of


def _inertia_of(runs: np.ndarray):
    return lambda x: np.array([squared_distances(x, c).min(axis=1).sum() for c in runs])


def _label(d: np.ndarray) -> pa.Array:
    return pa.array(d.argmin(axis=1), pa.int64())


def _roots(d: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32()), pa.array(np.sqrt(d).ravel()))


def _by_pieces(fn, size: int):
    """``fn`` of a block's vectors, added up over pieces of bounded size."""

    def run(columns: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(size)
        for piece in _pieces(columns[-1]):
            out += fn(piece)
        return out

    return run


class _Running:
    """Running sums of a value over rows in order of position; ``pot`` is the last.

    ``ends`` are the sums at the ends of bands of positions, ``within`` has single bands' values and vectors.
    """

    def __init__(self, ends: np.ndarray, within):
        self._ends, self._within = ends, within
        self.pot = float(ends[-1])

    def drawn(self, draws: list[float]) -> np.ndarray:
        """For each draw the vector of the first row whose running sum reaches it."""
        band = np.minimum(np.searchsorted(self._ends, draws, "left"), len(self._ends) - 1).tolist()
        held = self._within(sorted(set(band)))
        out = []
        for draw, b in zip(draws, band):
            values, vectors = held[b]
            before = float(self._ends[b - 1]) if b else 0.0
            out.append(vectors[min(int(np.searchsorted(before + np.cumsum(values), draw, "left")), len(values) - 1)])
        return np.array(out)


class _LocalPoints:
    """All vectors in one array, in the order of their keys; at most ``LOCAL_CELLS`` values."""

    def __init__(self, rows: DataFrame):
        table = rows.orderBy("_key").select("x").toArrow()
        self._x = matrix(table.column("x").combine_chunks())

    def summed(self, fn, size: int) -> np.ndarray:
        return _by_pieces(fn, size)([self._x])

    def rows(self, positions: list[int]) -> np.ndarray:
        return self._x[positions]

    def running(self, values) -> list[_Running]:
        """Sums for each column of ``values`` (a block's vectors to a matrix)."""
        found = np.concatenate([values(x) for x in _pieces(self._x)])
        rows = lambda j: lambda bands: {b: (found[b : b + 1, j], self._x[b : b + 1]) for b in bands}
        return [_Running(np.cumsum(found[:, j]), rows(j)) for j in range(found.shape[1])]

    def release(self) -> None:
        pass


class _SpreadPoints:
    """Vectors in the order of their keys, persisted in the cluster as blocks of consecutive rows (8 bytes a value).

    A task's blocks are one range of keys; a position is its range's start, its block's first row and the place in there.
    """

    def __init__(self, rows: DataFrame, n: int, width: int):
        self._tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n * width // TASK_CELLS))
        most = max(1, BLOCK_CELLS // width)

        def packed(batches):
            first = 0
            for part, x in blocks(batches):
                for i in range(0, len(x), most):
                    piece = np.ascontiguousarray(x[i : i + most])
                    columns = [pa.array(part[:1]), pa.array([first]), pa.array([piece.tobytes()])]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "first", "x"])
                    first += len(piece)

        ranged = rows.repartitionByRange(self._tasks, "_key").sortWithinPartitions("_key").select(F.spark_partition_id().alias("part"), "x")
        self._frame = ranged.mapInArrow(packed, "part int, first long, x binary").persist()
        self._width, self._n = width, n
        self._band = max(1024, math.isqrt(n))  # bands are few, and each is small
        sizes = self._frame.groupBy("part").agg(F.sum(F.octet_length("x")).alias("bytes")).orderBy("part").collect()  # one row a task
        self._starts, before = {}, 0
        for r in sizes:
            self._starts[r["part"]] = before
            before += r["bytes"] // (8 * width)

    def _mapped(self, fn, schema: str) -> DataFrame:
        """``fn`` of an iterator of (first position, vectors) in each task."""
        starts, width = self._starts, self._width

        def run(batches):
            def held():
                for batch in batches:
                    for part, first, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                        yield starts[part] + first, np.frombuffer(x.as_buffer()).reshape(-1, width)

            return fn(held())

        return self._frame.mapInArrow(run, schema)

    def summed(self, fn, size: int) -> np.ndarray:
        add = _by_pieces(fn, size)

        def run(held):
            out = None
            for _, x in held:
                out = add([x]) if out is None else out + add([x])
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([out])], ["part"])

        return added(self._mapped(run, "part array<double>"), size, self._tasks)

    def _where(self, wanted) -> dict[int, np.ndarray]:
        """Vectors of the positions that ``wanted`` (an array of positions to one of booleans) picks: few rows."""

        def run(held):
            for first, x in held:
                at = np.arange(first, first + len(x))
                own = wanted(at)
                if own.any():
                    yield pa.RecordBatch.from_arrays([pa.array(at[own]), pa.array(list(x[own]), pa.list_(pa.float64()))], ["position", "x"])

        return {r["position"]: np.array(r["x"]) for r in self._mapped(run, "position long, x array<double>").collect()}

    def rows(self, positions: list[int]) -> np.ndarray:
        own = np.array(sorted(set(positions)))
        found = self._where(lambda at: np.isin(at, own))
        return np.array([found[p] for p in positions], dtype=float)

    def running(self, values) -> list[_Running]:
        """Sums over bands of consecutive positions now, in one pass for all columns; rows of single bands when they are asked for."""
        size = self._band

        def run(held):
            for first, x in held:
                band = np.arange(first, first + len(x)) // size
                cuts = np.flatnonzero(np.diff(band, prepend=-1))
                sums = np.add.reduceat(np.concatenate([values(p) for p in _pieces(x)]), cuts, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(band[cuts]), pa.array(list(sums), pa.list_(pa.float64()))], ["band", "s"])

        found = self._mapped(run, "band long, s array<double>").toArrow()  # a row a block or band
        parts = matrix(found.column("s").combine_chunks())
        sums = np.zeros((-(-self._n // size), parts.shape[1]))
        np.add.at(sums, found.column("band").to_numpy(), parts)

        def within(j: int):
            def of(bands: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
                found = self._where(lambda at: np.isin(at // size, bands))  # a few bands of about sqrt(n) rows
                held: dict[int, list] = {b: [] for b in bands}
                for position in sorted(found):
                    held[position // size].append(found[position])
                vectors = {b: np.array(own) for b, own in held.items()}
                return {b: (values(x)[:, j], x) for b, x in vectors.items()}

            return of

        return [_Running(np.cumsum(sums[:, j]), within(j)) for j in range(sums.shape[1])]

    def release(self) -> None:
        self._frame.unpersist()


class KMeans(Estimator):
    """Lloyd's rounds from k-means++ or random centres.

    Rounds end once the centres' shift (Frobenius norm) is at most ``tol`` times the mean variance of the features. A cluster
    without rows moves to the origin. ``random_state`` None is seed 0; run i of ``n_init`` has seed + i. Up to ``local_cells`` values
    (rows times features) the rounds run on the driver, with the same draws and sums; 0 keeps them all in the cluster.
    """

    cluster_centers_: np.ndarray | None = None
    inertia_: float | None = None
    n_iter_: int | None = None
    _fit_rows: DataFrame | None = None

    def __init__(
        self,
        *,
        n_clusters: int = 8,
        init: str = "k-means++",
        n_init: int | None = None,
        max_iter: int = 300,
        tol: float = 1e-4,
        random_state: int | None = None,
        n_jobs: int = 1,
        local_cells: int | None = None,
    ):
        if init not in ("k-means++", "random"):
            raise ValueError("init must be 'k-means++' or 'random'")
        if n_clusters < 1:
            raise ValueError("n_clusters must be >= 1")
        if n_init is not None and n_init < 1:
            raise ValueError("n_init must be >= 1")
        self.n_clusters, self.init, self.max_iter, self.tol = n_clusters, init, max_iter, tol
        self.n_init = n_init
        self.random_state, self.n_jobs, self.local_cells = random_state, n_jobs, local_cells

    @property
    def runs(self) -> int:
        """Restarts: as given, else 1 for k-means++ and 10 for random centres."""
        return self.n_init if self.n_init is not None else 1 if self.init == "k-means++" else 10

    def fit(self, df: DataFrame, features: str | list[str], id_col: str | None = None) -> KMeans:
        """``id_col`` (unique) fixes which row a drawn position means; without it the rows' values do."""
        found = Features.of(df, features).checked(df)
        seen = moments(df, found)
        n, limit = seen.count, self.tol * float(seen.variance.mean())
        if n < self.n_clusters:
            raise ValueError(f"n_samples={n} should be >= n_clusters={self.n_clusters}")
        key = F.col(id_col) if id_col else found.vector()
        rows = df.select(key.alias("_key"), found.vector().alias("x"))
        local = LOCAL_CELLS if self.local_cells is None else self.local_cells
        points = _LocalPoints(rows) if n * found.width <= local else _SpreadPoints(rows, n, found.width)
        try:
            best = None
            together = max(1, SUMS_CELLS // (self.n_clusters * (found.width + 1)))
            for first in range(0, self.runs, together):
                draws = [Pcg32(((self.random_state or 0) + run) % WORD) for run in range(first, min(self.runs, first + together))]
                starts = [self._plus_plus(points, n, d) for d in draws] if self.init == "k-means++" else self._random(points, n, draws)
                for result in self._lloyd(points, np.array(starts), limit):
                    if best is None or result[1] < best[1]:
                        best = result
        finally:
            points.release()
        self.cluster_centers_, self.inertia_, self.n_iter_ = best
        self._features, self._fit_rows = found, df
        return self

    def _random(self, points: _LocalPoints | _SpreadPoints, n: int, draws: list[Pcg32]) -> np.ndarray:
        """For each run the first entries of a shuffle; ``moved`` holds only the places that a swap has touched."""
        chosen = []
        for rng in draws:
            moved: dict[int, int] = {}
            for i in range(self.n_clusters):
                j = i + rng.below(n - i)
                chosen.append(moved.get(j, j))
                moved[j] = moved.get(i, i)
        found = points.rows(chosen)
        return found.reshape(len(draws), self.n_clusters, -1)

    def _plus_plus(self, points: _LocalPoints | _SpreadPoints, n: int, rng: Pcg32) -> np.ndarray:
        """Each next centre is the best of a few rows drawn by their squared distance to the nearest centre so far.

        One pass a centre: the sums that rate the candidates are, for the best one, those that the next draws need.
        """
        centers = points.rows([rng.below(n)])
        trials = 2 + math.floor(math.log(self.n_clusters))
        nearest = points.running(lambda x, now=centers: squared_distances(x, now))[0]
        while len(centers) < self.n_clusters:
            if nearest.pot == 0:
                candidates = points.rows([rng.below(n)])
            else:
                candidates = nearest.drawn([rng.uniform() * nearest.pot for _ in range(trials)])

            def rated(x, now=centers, others=candidates):
                return np.minimum(squared_distances(x, now).min(axis=1)[:, None], squared_distances(x, others))

            found = points.running(rated)
            best = int(np.argmin([f.pot for f in found]))
            centers, nearest = np.vstack([centers, candidates[best]]), found[best]
        return centers

    def _lloyd(self, points: _LocalPoints | _SpreadPoints, centers: np.ndarray, limit: float) -> list[tuple[np.ndarray, float, int]]:
        """Rounds of several runs together (a run, a centre, a feature); each ends by its own shift, and all share the passes."""
        runs, k, p = centers.shape
        rounds = np.zeros(runs, dtype=int)
        going = np.arange(runs)
        for _ in range(self.max_iter):
            table = points.summed(_sums_of(centers[going]), len(going) * k * (p + 1)).reshape(-1, k, p + 1)
            size = table[..., p:]
            if (size == 0).any():
                log.warning("%d clusters have no rows; their centres move to the origin", int((size == 0).sum()))
            new = np.where(size > 0, table[..., :p] / np.maximum(size, 1), 0.0)
            shift = np.sqrt(((new - centers[going]) ** 2).sum(axis=(1, 2)))
            centers[going] = new
            rounds[going] += 1
            going = going[~(shift <= limit)]
            if not len(going):
                break
        inertia = points.summed(_inertia_of(centers), runs)
        return [(c, float(i), int(r)) for c, i, r in zip(centers, inertia, rounds)]

    def fit_predict(self, df: DataFrame, features: str | list[str], id_col: str | None = None, output: str = "prediction") -> DataFrame:
        return self.fit(df, features, id_col).predict(df, output=output)

    def fit_transform(self, df: DataFrame, features: str | list[str], id_col: str | None = None, output: str = "distances") -> DataFrame:
        return self.fit(df, features, id_col).transform(df, output=output)

    @property
    def labels_(self) -> DataFrame | None:
        """The rows of fit with their ``label``."""
        return None if self._fit_rows is None else self.predict(self._fit_rows, output="label")

    def _squared(self, features: Features) -> list[str]:
        return [" + ".join(f"pow({e} - {double(v)}, 2)" for e, v in zip(features.sql(), c)) for c in self.cluster_centers_]

    def _mapped(self, df: DataFrame, features: Features, outputs: list[tuple[str, T.DataType, Callable]]) -> DataFrame:
        """``df`` with columns that NumPy computes from each vector's squared distances, in one pass."""
        centers = self.cluster_centers_

        def run(batches):
            for batch in batches:
                found = [squared_distances(p, centers) for p in _pieces(matrix(batch.column(batch.num_columns - 1)))]
                d = np.concatenate([np.zeros((0, len(centers))), *found])
                columns = [fn(d) for _, _, fn in outputs]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], *(name for name, _, _ in outputs)])

        wide = df.withColumn("_x", features.vector())
        return wide.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(name, kind) for name, kind, _ in outputs)]))

    def predict(self, df: DataFrame, features: str | list[str] | None = None, output: str = "prediction") -> DataFrame:
        """``df`` with the nearest centre's number, the lowest of equally near ones."""
        found = self._of(df, features)
        if self.cluster_centers_.size <= SQL_CELLS:
            pairs = ", ".join(f"struct({d} AS d, {j}L AS k)" for j, d in enumerate(self._squared(found)))
            return df.withColumn(output, F.expr(f"array_min(array({pairs})).k"))
        return self._mapped(df, found, [(output, T.LongType(), _label)])

    def transform(self, df: DataFrame, features: str | list[str] | None = None, output: str = "distances") -> DataFrame:
        """``df`` with an array of distances to all centres."""
        found = self._of(df, features)
        if self.cluster_centers_.size <= SQL_CELLS:
            return df.withColumn(output, F.expr(f"array({', '.join(f'sqrt({d})' for d in self._squared(found))})"))
        return self._mapped(df, found, [(output, T.ArrayType(T.DoubleType()), _roots)])

    def assign(self, df: DataFrame, features: str | list[str] | None = None, prediction: str = "prediction", distances: str = "distances") -> DataFrame:
        """``df`` with what ``predict`` and ``transform`` add, in one pass."""
        found = self._of(df, features)
        if self.cluster_centers_.size <= SQL_CELLS:
            return self.transform(self.predict(df, features, prediction), features, distances)
        return self._mapped(df, found, [(prediction, T.LongType(), _label), (distances, T.ArrayType(T.DoubleType()), _roots)])

    def score(self, df: DataFrame, features: str | list[str] | None = None) -> float:
        """The negative inertia of ``df``."""
        found = self._of(df, features)
        return -float(summed(df.select(found.vector().alias("x")), _by_pieces(_inertia_of(self.cluster_centers_[None]), 1), 1)[0])

    def centers_df(self, spark) -> DataFrame:
        """``cluster, center``."""
        self._fitted()
        return spark.createDataFrame([(j, [float(v) for v in c]) for j, c in enumerate(self.cluster_centers_)], "cluster long, center array<double>")

    @classmethod
    def from_centers(cls, centers: np.ndarray, features: Features) -> KMeans:
        """A model with given centres, as if fitted."""
        out = cls(n_clusters=len(centers))
        out.cluster_centers_, out._features = np.asarray(centers, dtype=float), features
        return out
