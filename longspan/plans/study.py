"""The composed study: split, guard, fit, validate, and forecast in batches.

``Study.fit`` trains everything on the training roles; the validation tables
and ``forecast`` are lazy plans over long score rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspan.operators import audit, calibration, discrimination, fusion, modality, neighbors, splits, trajectory
from longspan.operators.checks import TRAIN_ROLES, VALIDATION_ROLES, require_split_safety
from longspan.operators.survival import HazardEnsemble, fit_together, survival_forest
from longspan.session import cut_lineage
from longspan.sources import contracts

TWINS = 5


@dataclass(frozen=True)
class Forecast:
    """Lazy tables of one batch of profiles, all keyed by the profile id."""

    risks: DataFrame
    trajectory: DataFrame
    drivers: DataFrame
    twins: DataFrame
    twin_trajectories: DataFrame
    warnings: DataFrame
    survival_curve: DataFrame


@dataclass
class Study:
    """Fitted models and their training tables.

    ``params`` are passed to the hazard ensembles (trees, depth, ...).
    """

    seed: int = 42
    n_bootstrap: int = 12
    kind: str = "boosted"
    groups: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(contracts.MODEL_GROUPS))
    params: Mapping[str, object] = field(default_factory=dict)
    forest_trees: int = 200
    rows: DataFrame | None = None
    trajectories: DataFrame | None = None
    models: dict[str, HazardEnsemble] = field(default_factory=dict)
    forest: HazardEnsemble | None = None
    regression: trajectory.RidgeTrajectory | None = None
    band: DataFrame | None = None
    space: neighbors.NeighborSpace | None = None
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    reference: DataFrame | None = None

    @property
    def features(self) -> list[str]:
        return [f for columns in self.groups.values() for f in columns]

    def _where(self, roles: Sequence[str]) -> DataFrame:
        return self.rows.where(F.col("role").isin(*roles))

    @property
    def train(self) -> DataFrame:
        return self._where(TRAIN_ROLES)

    @property
    def validation(self) -> DataFrame:
        return self._where(VALIDATION_ROLES)

    def fit(
        self,
        baseline: DataFrame,
        trajectories: DataFrame,
        features: DataFrame,
        visits: DataFrame,
        draw: Column | None = None,
    ) -> "Study":
        """Assign roles, check them, and fit on the training roles.

        The wide baseline (one row per participant) is written before the roles are
        drawn from it and again with them, because every model reads it. The
        trajectories are written once for the fit, the band and the twins; the other
        long tables are only read by the safety check.
        """
        baseline = cut_lineage(baseline)
        roles = splits.assign_roles(baseline, self.seed, draw)
        self.rows = cut_lineage(baseline.join(roles.select("participant_id", "role"), "participant_id"))
        self.trajectories = cut_lineage(trajectories)
        require_split_safety(self.rows.select("participant_id", "cohort", "role"), features, visits)
        self.models = {
            group: HazardEnsemble(
                columns, self.kind, self.n_bootstrap, self.seed + 37 * i, **{"together": True, **self.params}
            )
            for i, (group, columns) in enumerate(self.groups.items())
        }
        if all(model.joint for model in self.models.values()):
            fit_together(list(self.models.values()), self.train)
        else:
            for model in self.models.values():
                model.fit(self.train)
        self.forest = survival_forest(self.features, self.forest_trees, self.seed)
        try:
            self.forest.fit(self.train)
        except ValueError:
            # No participant has every feature; the forest needs complete cases.
            self.forest = None
        self._fit_trajectory()
        self.space = neighbors.NeighborSpace(self.features).fit(self.train)
        self.ranges = modality.training_ranges(self.train, self.features)
        self.reference = cut_lineage(fusion.reference_risks(self.scores(self.train)))
        return self

    def _fit_trajectory(self) -> None:
        columns = self.features
        pairs = trajectory.training_pairs(self.trajectories, self.train, columns)
        self.regression = trajectory.RidgeTrajectory([*columns, "horizon_years"]).fit(pairs)
        held = self._where([r for r in VALIDATION_ROLES if r != "external_validation"])
        residuals = trajectory.training_pairs(self.trajectories, held, columns)
        self.band = cut_lineage(trajectory.residual_band(residuals, self.regression))

    def scores(self, frame: DataFrame) -> DataFrame:
        """participant_id, modality, replicate, horizon, risk; only for groups a person has."""
        parts = [
            model.predict_distribution(frame.where(modality.group_available(group, self.groups))).withColumn(
                "modality", F.lit(group)
            )
            for group, model in self.models.items()
        ]
        return reduce(DataFrame.unionByName, parts)

    def predict_batch(self, frame: DataFrame, disabled: Sequence[str] = ()) -> DataFrame:
        """participant_id, risk_1y, risk_3y, risk_5y."""
        return fusion.batch_risk(fusion.risk_distribution(self.scores(frame), disabled))

    def validate(self) -> dict[str, DataFrame]:
        """Validation tables by name; scores are computed and written once."""
        scores = cut_lineage(self.scores(self.validation))
        predictions = cut_lineage(
            self.validation.join(fusion.batch_risk(fusion.risk_distribution(scores)), "participant_id", "left")
        )
        external = predictions.where(F.col("role") == "external_validation")
        return {
            "predictions": predictions,
            "summary": discrimination.metrics_by_role(predictions),
            "calibration": calibration.quantile_bins(external, "event_by_3y", "risk_3y", 6),
            "subgroups": discrimination.subgroup_metrics(predictions),
            "ablation": fusion.ablation(scores, self.validation),
            "missingness": modality.missingness_by_cohort(self.rows),
        }

    def compare(self, other: "Study", names: tuple[str, str]) -> DataFrame:
        """Metrics of two fitted studies on the same validation rows."""
        labels = self.validation.select("participant_id", "event_by_3y")
        parts = []
        for name, study in zip(names, (self, other)):
            risks = study.predict_batch(self.validation).join(labels, "participant_id", "right")
            metrics = discrimination.binary_metrics(risks, "event_by_3y", "risk_3y")
            parts.append(metrics.select(F.lit(name).alias("model"), *discrimination.METRICS))
        return parts[0].unionByName(parts[1])

    def forecast(self, profiles: DataFrame, k: int = TWINS) -> Forecast:
        """Everything about a batch of profiles; one person is a batch of one."""
        profiles = cut_lineage(profiles)
        scores = cut_lineage(self.scores(profiles))
        twins = cut_lineage(self.space.query(profiles, k))
        series = neighbors.twin_series(twins, self.trajectories)
        projected = trajectory.profile_trajectory(
            profiles, self.regression, trajectory.twin_dispersion(series), self.band
        )
        curve = (
            self.forest.survival_function(profiles)
            if self.forest is not None
            else profiles.select("participant_id", F.lit(0.0).alias("time"), F.lit(1.0).alias("survival")).limit(0)
        )
        return Forecast(
            risks=fusion.risk_intervals(fusion.risk_distribution(scores)),
            trajectory=projected,
            drivers=fusion.modality_drivers(profiles, scores, self.reference),
            twins=neighbors.twin_summary(twins, self.rows),
            twin_trajectories=series,
            warnings=audit.participant_warnings(profiles, self.ranges),
            survival_curve=curve,
        )
