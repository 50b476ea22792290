"""Fixed-horizon risk classifiers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longspan.functions.columns import dot, sigmoid
from longspan.operators.isotonic import IsotonicMap
from longspan.operators.newton import LinearModel, fit_logistic
from longspan.operators.scaling import MedianImputer, Standardizer
from longspan.session import reused

VECTOR = "__features"


def assemble(frame: DataFrame, columns: Sequence[str], out: str = VECTOR) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(frame)


def positive_probability(column: str = "probability"):
    return vector_to_array(F.col(column))[1]


@dataclass
class CentroidRisk:
    """Closed-form classifier: direction between class means of standardised features."""

    columns: Sequence[str]
    imputer: MedianImputer | None = None
    scaler: Standardizer | None = None
    direction: dict[str, float] = field(default_factory=dict)
    intercept: float = 0.0

    def fit(self, frame: DataFrame, target: str = "event") -> "CentroidRisk":
        with reused(frame.select(*dict.fromkeys([*self.columns, target]))) as rows:
            return self._fit(rows, target)

    def _fit(self, frame: DataFrame, target: str) -> "CentroidRisk":
        self.imputer = MedianImputer(self.columns).fit(frame)
        filled = self.imputer.transform(frame)
        self.scaler = Standardizer(self.columns).fit(filled)
        z = self.scaler.transform(filled)
        y = F.col(target).cast("int")
        aggs = []
        for i, c in enumerate(self.columns):
            aggs += [F.avg(F.when(y == 1, F.col(c))).alias(f"p{i}"), F.avg(F.when(y == 0, F.col(c))).alias(f"n{i}")]
        row = z.agg(*aggs).first()
        self.direction, half = {}, 0.0
        for i, c in enumerate(self.columns):
            pos, neg = row[f"p{i}"], row[f"n{i}"]
            known = pos is not None and neg is not None
            self.direction[c] = pos - neg if known else 0.0
            half += (pos + neg) * self.direction[c] if known else 0.0
        self.intercept = -half / 2.0
        return self

    def logit(self):
        return dot([F.col(c) for c in self.columns], [self.direction[c] for c in self.columns]) + F.lit(self.intercept)

    def standardized(self, frame: DataFrame) -> DataFrame:
        return self.scaler.transform(self.imputer.transform(frame))

    def predict_risk(self, frame: DataFrame, out: str = "risk") -> DataFrame:
        """All columns of ``frame`` plus the risk; a pure projection."""
        if self.scaler is None:
            raise RuntimeError("CentroidRisk must be fitted before predict_risk")
        kept = frame.select("*", *[F.col(c).alias(f"__raw_{c}") for c in self.columns])
        scored = self.standardized(kept).withColumn(out, sigmoid(self.logit()))
        back = [F.col(f"__raw_{c}").alias(c) if c in self.columns else F.col(f"`{c}`") for c in frame.columns]
        return scored.select(*back, out)


def balanced_weights(frame: DataFrame, target: str, weight: str | None = None) -> tuple[dict[int, float], float]:
    """Class weights n / (2 n_class) and the total weight, from one two-row aggregate."""
    w = F.col(weight) if weight else F.lit(1.0)
    rows = frame.groupBy(F.col(target).cast("int").alias("y")).agg(F.sum(w).alias("n")).collect()
    sizes = {r.y: float(r.n) for r in rows if r.y is not None and r.n}
    total = sum(sizes.values())
    return {y: total / (2.0 * n) for y, n in sizes.items()}, total


@dataclass
class LogisticRisk:
    """Median impute, standardise, class-balanced logistic regression with unit L2 strength.

    The optimum is unique, and Newton's method on sums reaches it to rounding.
    """

    columns: Sequence[str]
    max_iter: int = 100
    balanced: bool = True
    imputer: MedianImputer | None = None
    scaler: Standardizer | None = None
    model: LinearModel | None = None

    def _prepare(self, frame: DataFrame) -> DataFrame:
        kept = frame.select("*", *[F.col(c).alias(f"__x_{c}") for c in self.columns])
        return self.scaler.transform(self.imputer.transform(kept))

    def fit(self, frame: DataFrame, target: str = "event", weight: str | None = None) -> "LogisticRisk":
        names = [f"__x_{c}" for c in self.columns]
        kept = frame.where(F.col(target).isNotNull()).select(
            F.col(target).cast("double").alias("__y"),
            (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("__w"),
            *[F.col(c).alias(f"__x_{c}") for c in self.columns],
        )
        with reused(kept) as rows:
            return self._fit(rows, names)

    def _fit(self, kept: DataFrame, names: Sequence[str]) -> "LogisticRisk":
        self.imputer = MedianImputer(names).fit(kept)
        filled = self.imputer.transform(kept)
        self.scaler = Standardizer(names).fit(filled)
        classes, _ = balanced_weights(kept, "__y", "__w")
        if self.balanced:
            weight_of = F.when(F.col("__y") == 1, classes.get(1, 1.0)).otherwise(classes.get(0, 1.0))
            filled = filled.withColumn("__w", F.col("__w") * weight_of)
        ready = self.scaler.transform(filled).select(
            F.array(*[F.col(c) for c in names]).alias("x"), F.col("__y").alias("y"), F.array("__w").alias("w")
        )
        with reused(ready) as rows:
            self.model = fit_logistic(rows, len(names), penalty=1.0, max_iterations=self.max_iter)[0]
        return self

    def predict_risk(self, frame: DataFrame, out: str = "risk") -> DataFrame:
        if self.model is None:
            raise RuntimeError("LogisticRisk must be fitted before predict_risk")
        risk = self.model.probability([F.col(f"__x_{c}") for c in self.columns])
        return self._prepare(frame).select(*[F.col(f"`{c}`") for c in frame.columns], risk.alias(out))

    def coefficients(self) -> dict[str, float]:
        return dict(zip(self.columns, self.model.coefficients))


@dataclass
class BoostedRisk:
    """Gradient-boosted trees with missingness indicators and optional isotonic calibration."""

    columns: Sequence[str]
    n_estimators: int = 500
    learning_rate: float = 0.05
    max_depth: int = 5
    seed: int = 42
    calibrate: bool = False
    folds: int = 5
    key: str = "participant_id"
    imputer: MedianImputer | None = None
    models: list = field(default_factory=list)
    calibrators: list = field(default_factory=list)

    def names(self) -> list[str]:
        return [f"__x_{c}" for c in self.columns] + [f"__m_{c}" for c in self.columns]

    def _prepare(self, frame: DataFrame) -> DataFrame:
        kept = frame.select(
            "*",
            *[F.col(c).cast("double").alias(f"__x_{c}") for c in self.columns],
            *[F.col(c).isNull().cast("double").alias(f"__m_{c}") for c in self.columns],
        )
        return assemble(self.imputer.transform(kept), self.names()).drop(*self.names())

    def _learner(self) -> GBTClassifier:
        return GBTClassifier(
            featuresCol=VECTOR, labelCol="__y", maxIter=self.n_estimators, stepSize=self.learning_rate,
            maxDepth=self.max_depth, seed=self.seed,
        )

    def fit(self, frame: DataFrame, target: str = "event") -> "BoostedRisk":
        labelled = frame.where(F.col(target).isNotNull())
        names = [f"__x_{c}" for c in self.columns]
        self.imputer = MedianImputer(names, empty=0.0).fit(
            labelled.select(*[F.col(c).cast("double").alias(f"__x_{c}") for c in self.columns])
        )
        ready = self._prepare(labelled).withColumn("__y", F.col(target).cast("double"))
        if not self.calibrate:
            self.models, self.calibrators = [self._learner().fit(ready)], []
            return self
        fold = F.pmod(F.xxhash64(F.col(self.key), F.lit(self.seed)), F.lit(self.folds)).alias("__fold")
        self.models, self.calibrators = [], []
        with reused(ready.select("__y", VECTOR, fold)) as ready:
            for k in range(self.folds):
                model = self._learner().fit(ready.where(F.col("__fold") != k))
                held = model.transform(ready.where(F.col("__fold") == k)).select("__y", positive_probability().alias("__s"))
                self.models.append(model)
                self.calibrators.append(IsotonicMap().fit(held, "__y", "__s"))
        return self

    def predict_risk(self, frame: DataFrame, out: str = "risk") -> DataFrame:
        """Probability; with calibration the mean over the fold models' calibrated scores."""
        if not self.models:
            raise RuntimeError("BoostedRisk must be fitted before predict_risk")
        scored = self._prepare(frame)
        parts = []
        for k, model in enumerate(self.models):
            raw, prob, label = f"__raw{k}", f"__prob{k}", f"__label{k}"
            model = model.copy({model.rawPredictionCol: raw, model.probabilityCol: prob, model.predictionCol: label})
            scored = model.transform(scored).withColumn(f"__s{k}", positive_probability(prob)).drop(raw, prob, label)
            if self.calibrators:
                scored = self.calibrators[k].transform(scored, f"__s{k}", f"__c{k}")
                parts.append(F.col(f"__c{k}"))
            else:
                parts.append(F.col(f"__s{k}"))
        mean = sum(parts[1:], parts[0]) / float(len(parts))
        return scored.select(*[F.col(f"`{c}`") for c in frame.columns], mean.alias(out))

    def feature_importance(self, spark: SparkSession) -> DataFrame:
        """(feature, importance) of the first fitted model, indicators included."""
        values = self.models[0].featureImportances.toArray()
        labels = [*self.columns, *[f"{c}__missing" for c in self.columns]]
        return spark.createDataFrame(
            [(f, float(v)) for f, v in zip(labels, values)], "feature string, importance double"
        ).orderBy(F.desc("importance"), "feature")


def fit_multi_horizon(
    frame: DataFrame, columns: Sequence[str], horizons: Sequence[int] = (1, 3, 5), prefix: str = "event_", **params
) -> dict[int, BoostedRisk]:
    """One boosted model per horizon whose target column exists; NULL targets are dropped."""
    seed = params.pop("seed", 42)
    with reused(frame) as cached:
        return {
            h: BoostedRisk(columns, seed=seed + h, **params).fit(cached, f"{prefix}{h}")
            for h in horizons
            if f"{prefix}{h}" in frame.columns
        }
