"""Leave-one-season-out training, calibration and scoring with Spark ML.

A forest tells no more than 32 values of a feature apart. So rows are folded before the
fits: one aggregation makes a row, with its weight and mean labels, of all rows whose features
fall into the same bins. Squared error sees only these sums, so the trees are the
same, and a fit's many passes go over a bounded table instead of the log.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from math import inf, prod

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutlake.functions.scores import scores_from
from boutlake.tables import pinned

#: as many values of a feature as a tree tells apart (Spark ML's maxBins)
BINS = 32
#: where a tree samples, cells are parted by a hash of the rows until there can be this many: it takes or leaves a part, so about its share of every cell
SAMPLED_CELLS = 65_536
IDENTITY = ["_seq", "Season", "men_women", "DayNum", "A_TeamID", "B_TeamID", "Margin", "Total", "Outcome"]


@dataclass(frozen=True)
class Settings:
    """Forest and calibration settings; ``c`` is the inverse strength of the calibrator's L2 penalty."""

    trees: int = 20
    depth: int = 4
    step: float = 0.1
    subsample: float = 0.8
    c: float = 1.0
    seed: int = 7


def _binned(df: DataFrame, features: list[str], cuts: dict[str, list[float]]) -> tuple[DataFrame, list[str]]:
    """``df`` with missing features as 0 and the number of its bin for each feature that is cut; the columns that a model sees."""
    df = df.fillna(0.0, subset=features)
    cut = [f for f in features if cuts.get(f)]
    if cut:
        df = Bucketizer(splitsArray=[[-inf, *cuts[f], inf] for f in cut], inputCols=cut, outputCols=[f"_bin_{f}" for f in cut]).transform(df)
        df = df.withColumns({f"_bin_{f}": F.col(f"_bin_{f}") + 0.0 for f in cut})  # a plain number: as a Bucketizer's nominal attribute a tree would split it by any set of bins, not in order
    return df, [f"_bin_{f}" if f in cut else f for f in features]


def assembled(df: DataFrame, features: list[str], cuts: dict[str, list[float]] | None = None) -> DataFrame:
    """Missing features count as 0, as the very last step before the vector; features in ``cuts`` enter it by their bin."""
    df, seen = _binned(df, features, cuts or {})
    return VectorAssembler(inputCols=seen, outputCol="x").transform(df).drop(*set(seen) - set(features))


def quantile_grids(df: DataFrame, features: list[str], fold: str | None = None) -> dict:
    """For each fold (None: all rows) its number of rows and 255 quantiles of every feature with more values than there are bins."""
    df = df.fillna(0.0, subset=features)
    told = df.agg(*[F.approx_count_distinct(f, 0.02).alias(f) for f in features]).first()
    many = [f for f in features if told[f] > BINS]
    if not many:
        return {r[0]: (0, {}) for r in df.select(fold).distinct().collect()} if fold else {None: (0, {})}
    points = [i / (8 * BINS) for i in range(1, 8 * BINS)]
    grids = [F.percentile_approx(F.col(f).cast("double"), points, 10_000).alias(f) for f in many]
    rows = df.groupBy(F.col(fold) if fold else F.lit(None)).agg(F.count(F.lit(1)), *grids).collect()  # a row per fold
    return {r[0]: (r[1], {f: r[f] for f in many}) for r in rows}


def cut_points(grids: list[tuple[int, dict]]) -> dict[str, list[float]]:
    """Where features are cut into bins of about as many rows each, from the quantiles of the frames that are fitted together."""
    out = {}
    for f in {f for _, g in grids for f in g}:
        values = np.concatenate([g[f] for _, g in grids])
        share = np.concatenate([np.full(len(g[f]), n / len(g[f])) for n, g in grids])
        order = np.argsort(values, kind="stable")
        share = np.cumsum(share[order]) / share.sum()
        at = np.searchsorted(share, np.arange(1, BINS) / BINS - 1e-12)
        out[f] = sorted(set(values[order][at].tolist()))
    return out


def cells(df: DataFrame, features: list[str], s: Settings, cuts: dict[str, list[float]], labels: tuple[str, ...] = ("Margin", "Total"), weight: str | None = None) -> DataFrame:
    """A row per combination of bins, written once: ``x``, each label's weighted mean and weight ``w_label``, the number of rows and of those won."""
    binned, seen = _binned(df, features, cuts)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    most = prod(len(cuts[f]) + 1 if cuts.get(f) else 2 for f in features)
    part = F.pmod(F.xxhash64(*df.columns), F.lit(max(1, SAMPLED_CELLS // most))) if s.subsample < 1 else F.lit(0)
    sums = []
    for c in labels:
        own = F.sum(F.when(F.col(c).isNotNull(), w))
        sums += [(F.sum(w * F.col(c)) / F.when(own > 0, own)).alias(c), own.alias(f"w_{c}")]
    folded = pinned(binned.groupBy(*seen, part.alias("_part")).agg(*sums, F.count(F.lit(1)).alias("n"), F.sum("Outcome").alias("won")))
    return VectorAssembler(inputCols=seen, outputCol="x").transform(folded).drop(*seen, "_part")


def held_by_key(key: str, one_in: int = 5):
    """Whether a row is held out, by a hash of its key alone: the same on every run, in every order of the rows and in SQL. A null key is never held out."""
    return F.coalesce(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % one_in == 0, F.lit(False))


def held_by_seed(key: str, seed: int, one_in: int = 5):
    """Whether a row is held out in the random split of ``seed``: by a hash of both, the same in every order and partitioning of the rows."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(one_in)) == 0


def split_by_seed(df: DataFrame, key: str, seed: int, share: float = 0.8, parts: int = 64) -> list[DataFrame]:
    """A random split of ``df`` by ``seed``: (to fit, held out), a draw for each row.

    Spark's ``randomSplit`` sorts the rows of a partition and draws by seed and partition. Rows are dealt by
    their key into a fixed number of partitions first, so the parts are the same in every order and partitioning of ``df``.
    """
    return df.repartition(parts, key).randomSplit([share, 1.0 - share], seed)


def fit_regressor(df: DataFrame, label: str, s: Settings, weight: str | None = None):
    gbt = GBTRegressor(featuresCol="x", labelCol=label, predictionCol=f"pred_{label.lower()}", maxIter=s.trees, maxDepth=s.depth, stepSize=s.step, subsamplingRate=s.subsample, seed=s.seed)
    return (gbt.setWeightCol(weight) if weight else gbt).fit(df)


def fit_on_cells(folded: DataFrame, label: str, s: Settings) -> GBTRegressionModel:
    return fit_regressor(folded.where(F.col(f"w_{label}") > 0), label, s, f"w_{label}")


def outcomes(df: DataFrame, margin: str = "pred_margin", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows by margin and outcome, written once: all that a calibrator needs to know."""
    return pinned(df.groupBy(*by, margin, "Outcome").agg(F.count(F.lit(1)).cast("double").alias("w")))


def outcomes_of_cells(scored: DataFrame, margin: str = "pred_margin") -> DataFrame:
    """The same from scored cells."""
    both = F.explode(F.array(*[F.struct(F.lit(y).alias("Outcome"), n.cast("double").alias("w")) for y, n in ((1, F.col("won")), (0, F.col("n") - F.col("won")))])).alias("r")
    return pinned(scored.select(margin, both).groupBy(margin, "r.Outcome").agg(F.sum("r.w").alias("w")).where("w > 0"))


def fit_outcomes(counted: DataFrame, s: Settings, margin: str = "pred_margin") -> LogisticRegressionModel:
    """Outcome on margin from ``outcomes``, with an L2 penalty of 1 / (c * n)."""
    n = max(1.0, counted.agg(F.sum("w")).first()[0] or 0.0)
    v = VectorAssembler(inputCols=[margin], outputCol="m").transform(counted)
    return LogisticRegression(featuresCol="m", labelCol="Outcome", weightCol="w", regParam=1.0 / (s.c * n), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-12).fit(v)


def fit_calibrator(df: DataFrame, s: Settings, margin: str = "pred_margin") -> LogisticRegressionModel:
    """Outcome on predicted margin with an L2 penalty of 1 / (c * n). Rows of one margin and outcome are folded to one first."""
    return fit_outcomes(outcomes(df, margin), s, margin)


def probability(df: DataFrame, model: LogisticRegressionModel, margin: str = "pred_margin", out: str = "pred_prob") -> DataFrame:
    """The calibrated probability as an expression: no Python and no vectors in scoring."""
    a, b = float(model.coefficients[0]), float(model.intercept)
    return df.withColumn(out, 1.0 / (1.0 + F.exp(-(F.col(margin) * a + b))))


@dataclass
class TwoHeads:
    """Margin, total and calibrated probability. ``before`` is a hook on the frame to be scored, such as one that adds a column."""

    margin: GBTRegressionModel
    total: GBTRegressionModel
    calibrator: LogisticRegressionModel
    features: list[str]
    before: Callable[[DataFrame], DataFrame] | None = None
    cuts: dict[str, list[float]] | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        df = self.before(df) if self.before else df
        scored = self.total.transform(self.margin.transform(assembled(df, self.features, self.cuts)))
        return probability(scored, self.calibrator).drop("x")

    def scores(self, df: DataFrame) -> DataFrame:
        a, b = scores_from(F.col("pred_total"), F.col("pred_margin"))
        return self.transform(df).withColumns({"pred_a": a, "pred_b": b})


    def save(self, path: str) -> None:
        """Writes heads, calibrator, feature names and cuts to a folder; the hook is code and isn't written."""
        for name in ("margin", "total", "calibrator"):
            getattr(self, name).write().overwrite().save(f"{path}/{name}")
        SparkSession.active().createDataFrame([(self.features, self.cuts or {})], "features array<string>, cuts map<string, array<double>>").write.mode("overwrite").json(f"{path}/features")

    @staticmethod
    def load(path: str, before: Callable[[DataFrame], DataFrame] | None = None) -> TwoHeads:
        features, cuts = SparkSession.active().read.schema("features array<string>, cuts map<string, array<double>>").json(f"{path}/features").first()
        return TwoHeads(GBTRegressionModel.load(f"{path}/margin"), GBTRegressionModel.load(f"{path}/total"), LogisticRegressionModel.load(f"{path}/calibrator"), list(features), before, cuts)


class TwoHeadsModel(Model):
    """``TwoHeads`` as a stage of a Spark ML pipeline."""

    def __init__(self, heads: TwoHeads):
        super().__init__()
        self.heads = heads

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.heads.transform(dataset)


class TwoHeadsTrainer(Estimator):
    """``train`` as a stage of a Spark ML pipeline."""

    def __init__(self, features: list[str], settings: Settings, weight: str | None = None):
        super().__init__()
        self.features, self.settings, self.weight = features, settings, weight

    def _fit(self, dataset: DataFrame) -> TwoHeadsModel:
        return TwoHeadsModel(train(dataset, self.features, self.settings, self.weight))


def train(df: DataFrame, features: list[str], s: Settings, weight: str | None = None, written: bool = False) -> TwoHeads:
    """Both heads and the calibrator on all rows of ``df``. What is needed of it is written once, unless it is a ``written`` table already."""
    x = df.where("Margin IS NOT NULL")
    if not written:
        x = pinned(x.select(*dict.fromkeys([*features, "Margin", "Total", "Outcome", *([weight] if weight else [])])))
    cuts = cut_points(list(quantile_grids(x, features).values()))
    folded = cells(x, features, s, cuts, weight=weight)
    margin, total = fit_on_cells(folded, "Margin", s), fit_on_cells(folded, "Total", s)
    return TwoHeads(margin, total, fit_outcomes(outcomes_of_cells(margin.transform(folded)), s), features, cuts=cuts)


def leave_one_out(df: DataFrame, features: list[str], s: Settings, fold: str = "Season", holdout: list[int] = (), parallel: int = 8, written: bool = False) -> DataFrame:
    """Out-of-fold predictions: every season scored by a model that has not seen it; ``holdout`` seasons take no part.

    The frame is written once, in a folder a fold (``written``: it is such a table already). Folds
    are independent jobs from a small driver pool: each cuts features by the other folds' quantiles and
    folds their rows to cells, so that its fits read these only. The calibrator is cross-fitted: a
    season's is fitted on the other seasons' out-of-fold margins, counted once for all of them. The
    out-of-fold frame is written once to the shared folder.
    """
    used = df.where(~F.col(fold).isin(*holdout)) if holdout else df
    x = used.where("Margin IS NOT NULL") if written else pinned(used.where("Margin IS NOT NULL"), [fold])
    grids = {k: g for k, g in quantile_grids(x, features, fold).items() if k is not None}
    folds = sorted(grids)

    def scored(k):
        cuts = cut_points([g for other, g in grids.items() if other != k])
        folded = cells(x.where(F.col(fold) != k), features, s, cuts)
        m, t = fit_on_cells(folded, "Margin", s), fit_on_cells(folded, "Total", s)
        return t.transform(m.transform(assembled(x.where(F.col(fold) == k), features, cuts))).drop("x")

    with ThreadPoolExecutor(parallel) as pool:
        oof = pinned(reduce(DataFrame.unionByName, pool.map(scored, folds)))
        counted = outcomes(oof, by=(fold,))
        calibrators = list(pool.map(lambda k: fit_outcomes(counted.where(F.col(fold) != k), s), folds))
    z = F.lit(None).cast("double")
    for k, c in zip(folds, calibrators):
        z = F.when(F.col(fold) == k, F.col("pred_margin") * float(c.coefficients[0]) + float(c.intercept)).otherwise(z)
    return oof.withColumn("pred_prob", 1.0 / (1.0 + F.exp(-z)))


@dataclass
class FoldModel:
    """A regressor and how its features are cut."""

    forest: GBTRegressionModel
    features: list[str]
    cuts: dict[str, list[float]]

    @property
    def featureImportances(self):
        return self.forest.featureImportances

    def transform(self, df: DataFrame) -> DataFrame:
        return self.forest.transform(assembled(df, self.features, self.cuts)).drop("x")


def fit_whole(df: DataFrame, features: list[str], s: Settings, label: str = "Margin") -> FoldModel:
    """One regressor on the cells of all rows of ``df``, a written table."""
    cuts = cut_points(list(quantile_grids(df, features).values()))
    return FoldModel(fit_on_cells(cells(df, features, s, cuts, (label,)), label, s), features, cuts)


def fold_models(df: DataFrame, features: list[str], s: Settings, fold: str = "Season", label: str = "Margin", parallel: int = 8, written: bool = False) -> list[FoldModel]:
    """One regressor per fold, each fitted on the cells of the other folds; the frame is written once for all of them."""
    x = df if written else pinned(df.select(*dict.fromkeys([fold, *features, label, "Outcome"])), [fold])
    grids = {k: g for k, g in quantile_grids(x, features, fold).items() if k is not None}

    def one(k):
        cuts = cut_points([g for other, g in grids.items() if other != k])
        return FoldModel(fit_on_cells(cells(x.where(F.col(fold) != k), features, s, cuts, (label,)), label, s), features, cuts)

    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(one, sorted(grids)))


def predictions_log(oof: DataFrame, holdout: DataFrame) -> DataFrame:
    cols = [*IDENTITY, "pred_margin", "pred_total", "pred_prob"]
    return oof.select(*cols, F.lit("oof").alias("source")).unionByName(holdout.select(*cols, F.lit("holdout").alias("source")))


def ensemble(a: DataFrame, b: DataFrame, keys: list[str], w: float = 0.6, shrink: float = 0.9) -> DataFrame:
    """Weighted probability and shrunk spread of two models; where one is missing the other stands alone."""
    x = a.select(*keys, F.col("pred_prob").alias("pa"), F.col("pred_margin").alias("ma"))
    y = b.select(*keys, F.col("pred_prob").alias("pb"), F.col("pred_margin").alias("mb"))
    mix = lambda p, q: F.when(F.col(p).isNull(), F.col(q)).when(F.col(q).isNull(), F.col(p)).otherwise(w * F.col(p) + (1 - w) * F.col(q))
    return x.join(y, keys, "full_outer").select(*keys, mix("pa", "pb").alias("pred_prob"), (shrink * mix("ma", "mb")).alias("pred_margin"))


def importances(models: list, features: list[str], spark) -> DataFrame:
    """Mean importance over folds: a row per fold and feature, then one aggregation."""
    rows = [(k, f, float(v)) for k, m in enumerate(models) for f, v in zip(features, m.featureImportances.toArray())]
    return spark.createDataFrame(rows, "fold int, feature string, importance double").groupBy("feature").agg(F.avg("importance").alias("importance"))


def path_attribution(model, df: DataFrame, features: list[str], id_col: str = "_seq", top: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """The ``top`` contributions to each prediction, with base value and prediction; columns in ``keep`` go along.

    A contribution is the change of the node's mean along the path of each tree,
    credited to the feature split on, so base + all contributions = prediction.
    The forest (bounded by its settings) is flattened and sent to the executors.
    """
    forest, cuts = (model.forest, model.cuts) if isinstance(model, FoldModel) else (model, {})
    trees = [(w, _flat(t._call_java("rootNode"))) for w, t in zip(forest.treeWeights, forest.trees)]
    shared = df.sparkSession.sparkContext.broadcast(trees)
    binned, seen = _binned(df.select(id_col, *keep, *features), features, cuts)

    def run(batches):
        names = pa.array(features, pa.string())
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in seen])
            n, credit, base = len(x), np.zeros(x.shape), 0.0
            for w, nodes in shared.value:
                split, threshold, to_left, to_right, mean = (np.array(c) for c in zip(*[(f, t, *(to or (0, 0)), m) for f, t, to, m in nodes]))
                base += w * mean[0]
                at = np.zeros(n, int)
                while len(rows := np.flatnonzero(split[at] >= 0)):  # all rows go down one level
                    here, f = at[rows], split[at[rows]]
                    at[rows] = np.where(x[rows, f] <= threshold[here], to_left[here], to_right[here])
                    credit[rows, f] += w * (mean[at[rows]] - mean[here])
            order = np.argsort(-np.abs(credit), axis=1, kind="stable")[:, :top]
            ends = pa.array(np.arange(n + 1) * order.shape[1], pa.int32())
            lists = [names.take(pa.array(order.ravel())), pa.array(np.take_along_axis(credit, order, 1).ravel())]
            told = [pa.array(np.full(n, base)), pa.array(base + credit.sum(axis=1)), *[pa.ListArray.from_arrays(ends, v) for v in lists]]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (id_col, *keep)], *told], names=[id_col, *keep, "base", "explained", "drivers", "contributions"])

    own = ", ".join(f"`{c}` {binned.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    return binned.select(id_col, *keep, *seen).mapInArrow(run, f"{own}, base double, explained double, drivers array<string>, contributions array<double>")


def _flat(root) -> list[tuple]:
    """Nodes of a tree as (feature or -1, threshold, children, prediction). Inner predictions are means of the children by instance count."""
    out: list = []

    def add(node) -> tuple[int, float, float]:
        at = len(out)
        out.append(None)
        if node.getClass().getSimpleName() == "LeafNode":
            out[at] = (-1, 0.0, None, float(node.prediction()))
            return at, float(node.prediction()), float(node.impurityStats().count())
        left, pl, nl = add(node.leftChild())
        right, pr, nr = add(node.rightChild())
        mean = (pl * nl + pr * nr) / (nl + nr)
        split = node.split()
        out[at] = (int(split.featureIndex()), float(split.threshold()), (left, right), mean)
        return at, mean, nl + nr

    add(root)
    return out
