"""Exact nearest-neighbour search, classification and regression.

Every ``algorithm`` gives the same, exact neighbours. ``kd_tree`` and ``ball_tree`` deal the training rows to leaves of about
``leaf_size`` rows (more beyond 4,096 leaves) and send a query only to those that its bounds can't rule out; ``brute`` compares all;
``auto`` takes kd_tree for many rows of few features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.distance import Metric
from tabulon.operators.base import Estimator, Regression
from tabulon.plans.features import Features, check_rows
from tabulon.plans.neighbors import nearest

WEIGHTS = ("uniform", "distance")
#: Training rows up to which Spark may send all labels to every executor.
BROADCAST_LABELS = 1 << 17
ALGORITHMS = ("auto", "brute", "kd_tree", "ball_tree")


class _Neighbors(Estimator):
    n_samples_fit_: int | None = None

    def __init__(
        self,
        *,
        n_neighbors: int = 5,
        weights: str = "uniform",
        algorithm: str = "auto",
        leaf_size: int = 30,
        metric: str = "euclidean",
        p: float = 2.0,
        n_jobs: int = 1,
    ):
        if n_neighbors < 1:
            raise ValueError("n_neighbors must be >= 1")
        if weights not in WEIGHTS:
            raise ValueError("weights must be 'uniform' or 'distance'")
        if algorithm not in ALGORITHMS:
            raise ValueError(f"algorithm must be one of {', '.join(ALGORITHMS)}")
        if leaf_size < 1:
            raise ValueError("leaf_size must be >= 1")
        self.n_neighbors, self.weights, self.algorithm, self.leaf_size = n_neighbors, weights, algorithm, leaf_size
        self.metric, self.p, self.n_jobs = metric, p, n_jobs
        self._metric = Metric.of(metric, p)

    @property
    def n_neighbors_(self) -> int:
        return self.n_neighbors

    def fit(self, df: DataFrame, features: str | list[str], label: str | None = None, id_col: str = "id"):
        """Keeps the training rows (a plan, not a copy); ``id_col`` is unique and names neighbours."""
        found = Features.of(df, features).checked(df)
        row = df.agg(F.count("*"), F.expr(f"count_if({found.bad_sql()})")).first()
        check_rows(*row)
        columns = [id_col, *([found.array] if found.array else found.names), *([label] if label else [])]
        self._train, self._id, self._label = df.select(*dict.fromkeys(columns)), id_col, label
        self._features, self.n_samples_fit_ = found, row[0]
        return self

    def kneighbors(
        self, df: DataFrame, n_neighbors: int | None = None, return_distance: bool = True, id_col: str | None = None, features: str | list[str] | None = None
    ) -> DataFrame:
        """``query_id, rank, neighbor_id, distance`` of the nearest training rows of each row of ``df``; rank from 1.

        A training row asked about itself finds itself at distance 0. More neighbours than rows: all rows.
        """
        found = self._of(df, features)
        k = self.n_neighbors if n_neighbors is None else n_neighbors
        if k < 1:
            raise ValueError("n_neighbors must be >= 1")
        k = min(k, self.n_samples_fit_)
        out = nearest(df, found, id_col or self._id, self._train, self._fitted(), self._id, self.n_samples_fit_, k, self._metric, self.algorithm, self.leaf_size)
        return out if return_distance else out.drop("distance")

    def kneighbors_wide(self, df: DataFrame, n_neighbors: int | None = None, id_col: str | None = None) -> DataFrame:
        """``query_id, neighbor_ids, distances``: arrays in order of distance."""
        rows = self.kneighbors(df, n_neighbors, id_col=id_col)
        both = F.array_sort(F.collect_list(F.struct("rank", "neighbor_id", "distance")))
        return rows.groupBy("query_id").agg(both.alias("n")).select(
            "query_id", F.col("n.neighbor_id").alias("neighbor_ids"), F.col("n.distance").alias("distances")
        )

    def _labelled(self, df: DataFrame, id_col: str | None, features) -> DataFrame:
        """Neighbours with their labels and weights.

        Under distance weights the first neighbour at distance 0, if there is one, has weight 1 and all others 0.
        """
        if self._features is None:
            raise ValueError("Not fitted yet")
        if self._label is None:
            raise ValueError("fit had no label")
        rows = self.kneighbors(df, id_col=id_col, features=features)
        labels = self._train.select(F.col(self._id).alias("neighbor_id"), F.col(self._label).alias("label"))
        if self.n_samples_fit_ > BROADCAST_LABELS:  # files may look small enough to Spark, whatever they hold
            labels = labels.hint("merge")
        rows = rows.join(labels, "neighbor_id")
        if self.weights == "uniform":
            return rows.withColumn("weight", F.lit(1.0))
        exact = F.min(F.when(F.col("distance") == 0, F.col("rank"))).over(Window.partitionBy("query_id"))
        rows = rows.withColumn("exact", exact)
        inverse = F.when(F.col("distance") > 0, 1 / F.when(F.col("distance") > 0, F.col("distance")))
        alone = F.when(F.col("rank") == F.col("exact"), 1.0).otherwise(0.0)
        return rows.withColumn("weight", F.when(F.col("exact").isNull(), inverse).otherwise(alone))

    def _append(self, df: DataFrame, id_col: str | None, found: DataFrame, column: Column, output: str) -> DataFrame:
        own = found.select(F.col("query_id").alias("_query"), column.alias(output))
        return df.join(own, df[id_col or self._id] == own["_query"], "left").drop("_query")


class KNeighborsClassifier(_Neighbors):
    """Labels by a vote of neighbours; equal votes go to the lowest label."""

    classes_: list[int] | None = None

    def fit(self, df: DataFrame, features: str | list[str], label: str, id_col: str = "id") -> KNeighborsClassifier:
        super().fit(df, features, label, id_col)
        self.classes_ = sorted(r[0] for r in df.select(label).distinct().collect())
        return self

    def _votes(self, df, id_col, features) -> DataFrame:
        return self._labelled(df, id_col, features).groupBy("query_id", "label").agg(F.sum("weight").alias("vote"))

    def predict(self, df: DataFrame, id_col: str | None = None, features=None, output: str = "prediction") -> DataFrame:
        """``df`` with the label that has the most weight."""
        best = F.min_by("label", F.struct(-F.col("vote"), F.col("label")))
        found = self._votes(df, id_col, features).groupBy("query_id").agg(best.alias("label"))
        return self._append(df, id_col, found, F.col("label").cast("long"), output)

    def proba(self, df: DataFrame, id_col: str | None = None, features=None) -> DataFrame:
        """``query_id, label, probability`` for every class."""
        votes = self._votes(df, id_col, features)
        all_votes = votes.groupBy("query_id").agg(
            F.sum("vote").alias("total"), F.map_from_entries(F.collect_list(F.struct(F.col("label").cast("long"), "vote"))).alias("by")
        )
        label = F.explode(F.array(*(F.lit(c).cast("long") for c in self.classes_)))
        own = F.coalesce(F.try_element_at("by", F.col("label")), F.lit(0.0)) / F.col("total")
        return all_votes.withColumn("label", label).select("query_id", "label", own.alias("probability"))

    def predict_proba(self, df: DataFrame, id_col: str | None = None, features=None, output: str = "probabilities") -> DataFrame:
        """``df`` with an array of probabilities in the order of ``classes_``."""
        rows = F.array_sort(F.collect_list(F.struct("label", "probability")))
        found = self.proba(df, id_col, features).groupBy("query_id").agg(rows.alias("p"))
        return self._append(df, id_col, found, F.col("p.probability"), output)

    def score(self, df: DataFrame, label: str, id_col: str | None = None, features=None) -> float:
        """Share of rows whose prediction equals ``label``."""
        rows = self.predict(df.withColumn("_label", F.col(label)), id_col, features, "_predicted")
        found = rows.agg(F.avg((F.col("_predicted") == F.col("_label")).cast("double"))).first()[0]
        if found is None:
            raise ValueError("X must be non-empty")
        return found


class KNeighborsRegressor(_Neighbors, Regression):
    """Means of neighbours' labels, plain or weighted by 1 / distance."""

    def predict(self, df: DataFrame, id_col: str | None = None, features=None, output: str = "prediction") -> DataFrame:
        y = F.col("label").cast("double")
        found = self._labelled(df, id_col, features).groupBy("query_id").agg(
            (F.sum(y * F.col("weight")) / F.sum("weight")).alias("mean")
        )
        return self._append(df, id_col, found, F.col("mean"), output)
