"""Training, keeping and applying one model for each cluster.

Clusters are never pooled: each has its encoder, its features, its ensembles and its choice between them.
The latest labelled months are held out, made to look like the scored population by withdrawing
identities at the rate at which that population's are new, and used to choose the number of trees,
whether training withdraws identities too, and whether one family or the blend of both predicts.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import drift, encoding, features, models
from emberline.operators import selection as S
from emberline.schema import CATEGORIES, KEYS, MOST_HOLDOUT_ROWS, MOST_ROWS, PREDICTOR_MARGIN
from emberline.scratch import materialise
from emberline.sources.telemetry import read_json, row_id, write_json

ENCODED = (*[f"{kind}_{n}" for n in KEYS for kind in ("te", "tc")], *[f"cat_{c}" for c in CATEGORIES])
BLEND = "blend"


@dataclass
class Options:
    """How to train: trees of each family to try, tree depth, refits, held-out months and rows, caps and seed."""

    rounds: dict[str, int] = field(default_factory=lambda: {"gbt": 60, "forest": 60})
    depth: int = 6
    seeds: int = 3
    holdout: int = 3
    seed: int = 2026
    most_rows: int = MOST_ROWS
    most_holdout: int = MOST_HOLDOUT_ROWS
    dropout: str = "auto"
    patience: int = 300
    margin: float = PREDICTOR_MARGIN


@dataclass
class ClusterModel:
    """All that scores one cluster; no other cluster's state is in it. ``models`` are named ``<family>#<refit>``."""

    cluster: str
    features: list[str]
    fills: dict[str, float]
    prior: float
    stats: DataFrame
    codes: DataFrame
    models: dict[str, models.Model]
    seconds: float
    predictor: str

    def save(self, path: str) -> None:
        """Keeps the model below ``path``, replacing one that is there."""
        spark = self.stats.sparkSession
        at = f"{path.rstrip('/')}/{self.cluster}"
        self.stats.write.mode("overwrite").parquet(f"{at}/stats")
        self.codes.write.mode("overwrite").parquet(f"{at}/codes")
        for name, model in self.models.items():
            model.write().overwrite().save(f"{at}/models/{name.replace('#', '-')}")
        write_json(spark, f"{at}/manifest.json", {"cluster": self.cluster, "features": self.features, "fills": self.fills, "prior": self.prior, "seconds": self.seconds, "predictor": self.predictor, "models": list(self.models)})

    @staticmethod
    def load(spark: SparkSession, path: str, cluster: str) -> ClusterModel:
        at = f"{path.rstrip('/')}/{cluster}"
        known = read_json(spark, f"{at}/manifest.json")
        if known is None:
            raise FileNotFoundError(f"no model of {cluster} below {path}")
        kinds = {"gbt": GBTClassificationModel, "forest": RandomForestClassificationModel}
        kept = {name: kinds[family(name)].load(f"{at}/models/{name.replace('#', '-')}") for name in known["models"]}
        return ClusterModel(cluster, known["features"], known["fills"], known["prior"], spark.read.parquet(f"{at}/stats"), spark.read.parquet(f"{at}/codes"), kept, known["seconds"], known["predictor"])

    def selected(self) -> list[str]:
        """The models that predict: those of the chosen family, or all."""
        mine = [n for n in self.models if family(n) == self.predictor]
        return list(self.models) if self.predictor == BLEND or not mine else mine

    def encode(self, matrix: DataFrame) -> DataFrame:
        """The matrix with the encodings that the training jobs left; unseen keys get the prior and 0."""
        encoded = encoding.wide(encoding.with_statistics(matrix, self.stats, F.lit(self.prior)))
        return encoding.with_codes(matrix, self.codes).join(encoded, "jid", "left")

    def predict(self, matrix: DataFrame) -> DataFrame:
        """(jid, score) of every job: the one model's probability, or the ranks of several blended."""
        rows, _ = models.design(self.encode(matrix), self.features, self.fills)
        return _blended(rows, {n: self.models[n] for n in self.selected()})


def family(name: str) -> str:
    return name.partition("#")[0]


def _blended(rows: DataFrame, fitted: dict[str, models.Model]) -> DataFrame:
    """(jid, ..., score): ``rows`` scored by each model, blended by rank where there are several."""
    rows = rows.withColumn("__one", F.lit("all"))
    for k, model in enumerate(fitted.values()):
        rows = models.score(model, rows, f"s{k}")
    scored = materialise(rows.select("__one", "jid", *[f"s{k}" for k in range(len(fitted))]), "scores")
    if len(fitted) == 1:
        return scored.select("jid", F.col("s0").alias("score"))
    return S.rank_blend(scored, [f"s{k}" for k in range(len(fitted))], group="__one").select("jid", F.col("blend").alias("score"))


def _ap(rows: DataFrame, scores: DataFrame) -> float:
    joined = rows.select("jid", "target").join(scores, "jid").withColumn("cluster", F.lit("all"))
    return float(S.average_precision(joined).first().ap or 0.0)


def withdrawn(rows: DataFrame, rates: dict[str, float], prior: float, mask: Callable[[str, float], Column]) -> DataFrame:
    """``rows`` with each identity's encodings blanked where ``mask(field, rate)`` says so."""
    for name, rate in rates.items():
        if rate > 0:
            rows = drift.blank_identities(rows, mask(name, rate), (name,), prior)
    return rows


def like_scored(rows: DataFrame, rates: dict[str, float], prior: float, seed: int) -> DataFrame:
    """Held-out ``rows`` degraded to the scored population: whole categories withdrawn until as many rows are new as there.

    A null identity is new to the model whatever is withdrawn.
    """
    for name, rate in rates.items():
        gone = drift.category_holdout(rows, name, rate, str(seed)).select(F.col("category").alias("__gone")).distinct()
        marked = rows.join(gone, F.col(name) == F.col("__gone"), "left")
        rows = drift.blank_identities(marked, F.col("__gone").isNotNull() | F.col(name).isNull(), (name,), prior).drop("__gone")
    return rows


def _fit_families(train: DataFrame, valid: DataFrame, names: list[str], options: Options, wanted: tuple[str, ...]) -> tuple[dict[str, models.Model], dict[str, int], dict[str, float]]:
    """Models of the wanted families, the number of trees that ranks ``valid`` best, and their average precisions."""
    rows, fills = models.design(train, names)
    rows = materialise(rows.select("features", "target"), "train")
    held = materialise(models.design(valid, names, fills)[0].select("jid", "features", "target"), "valid")
    weight = positive_weight(train)
    with ThreadPoolExecutor(len(wanted)) as pool:
        fitted = dict(zip(wanted, pool.map(lambda f: models.fit(rows, weight, options.rounds[f], options.depth, options.seed, f), wanted), strict=True))
    trees, scores = {}, {}
    for name, model in fitted.items():
        trees[name], scores[name] = models.best_rounds(model, held, patience=options.patience)
    if len(fitted) > 1:
        scores[BLEND] = _ap(held, _blended(held, fitted))
    return fitted, trees, scores


def positive_weight(rows: DataFrame) -> float:
    """The weight of a positive (see ``class_weight``); no positive at all is an error."""
    weight = S.class_weight(rows.select("target", F.lit("all").alias("cluster"))).first()
    if weight is None or weight.weight is None:
        raise ValueError("the training jobs hold no failure")
    return float(weight.weight)


def labelled(acc: DataFrame, seconds: float, options: Options, spans: DataFrame | None = None) -> DataFrame:
    """The matrix of labelled jobs, newest first where there are over ``most_rows``; ``spans`` add whole-life columns."""
    matrix = with_spans(features.matrix(acc, seconds), spans).filter("target IS NOT NULL AND month IS NOT NULL")
    return materialise(S.recency_cap(matrix, options.most_rows), "matrix")


def with_spans(matrix: DataFrame, spans: DataFrame | None) -> DataFrame:
    """The matrix with whole-life columns, where ``spans`` are given: opt-in, and not early information."""
    from emberline.operators.lifespan import lifespan_features

    if spans is None:
        return matrix
    return matrix.join(lifespan_features(matrix, spans), "jid", "left")


def train_cluster(cluster: str, matrix: DataFrame, seconds: float, options: Options, reference: DataFrame | None = None) -> tuple[ClusterModel, dict]:
    """The model of a cluster's labelled ``matrix`` and a report; ``reference`` is the matrix of jobs to be scored.

    Without a reference nothing is known about drift: no identity is withdrawn and no feature dropped for its range.
    """
    split = S.out_of_time_split(matrix, options.holdout)
    train = materialise(split.filter("NOT is_holdout"), "train")
    valid = materialise(S.subsample(split.filter("is_holdout"), options.most_holdout, str(options.seed)), "valid")
    for name, rows in (("training", train), ("holdout", valid)):
        if rows.select("target").distinct().count() < 2:
            raise ValueError(f"{cluster}: the {name} jobs need both outcomes")
    names = [r.name for r in features.constant_columns(matrix, features.numeric_features(matrix)).filter("kept").collect()]
    rates, dropped = {}, []
    if reference is not None:
        rates = {r.field: r.rate for r in drift.unseen_rates(matrix, reference).collect() if r.rate is not None}
        shared = [c for c in names if c in reference.columns]
        dropped = [r.name for r in features.range_guard(matrix, reference, shared).filter("NOT kept").collect()]
        names = [c for c in names if c not in dropped]
    columns = [*names, *ENCODED]

    encoder = _encoder(train)
    encoded_train = materialise(_encoded_training(train, encoder), "encoded")
    natural = materialise(_encoded(valid, encoder), "encoded")
    scored_like = materialise(like_scored(natural, rates, encoder["prior"], options.seed), "encoded") if rates else natural

    def training_rows(rows: DataFrame, use: bool, prior: float, seed: int) -> DataFrame:
        return withdrawn(rows, rates, prior, lambda name, rate: drift.row_mask(F.col("jid"), rate, f"{name}{seed}")) if use else rows

    choices = {"off": [False], "on": [True]}.get(options.dropout, [False, True]) if rates else [False]
    probe = {}
    if len(choices) > 1:
        for use in choices:
            probe[use] = _fit_families(training_rows(encoded_train, use, encoder["prior"], options.seed), scored_like, columns, options, ("gbt",))[2]["gbt"]
    use = max(choices, key=lambda c: (probe.get(c, 0.0), not c))
    fitted, trees, scores = _fit_families(training_rows(encoded_train, use, encoder["prior"], options.seed), scored_like, columns, options, models.FAMILIES)
    predictor = S.choose_predictor(scores, BLEND, options.margin)

    total, learned = matrix.count(), train.count()
    final = {f: S.refit_rounds(n, total, learned) for f, n in trees.items()}
    encoder = _encoder(matrix)
    everything = materialise(_encoded_training(matrix, encoder), "encoded")
    wanted = models.FAMILIES if predictor == BLEND else (predictor,)
    weight, fills = positive_weight(matrix), models.medians(everything, columns)

    def refit(job: tuple[str, int]) -> models.Model:
        name, k = job
        seed = options.seed + 1000 * k
        rows = models.design(training_rows(everything, use, encoder["prior"], seed + 7), columns, fills)[0]
        return models.fit(materialise(rows.select("features", "target"), "refit"), weight, final[name], options.depth, seed, name)

    jobs = [(name, k) for k in range(max(1, options.seeds)) for name in wanted]
    with ThreadPoolExecutor(min(4, len(jobs))) as pool:
        kept = {f"{name}#{k}": model for (name, k), model in zip(jobs, pool.map(refit, jobs), strict=True)}
    report = {
        "cluster": cluster, "jobs": total, "holdout_jobs": valid.count(), "features": len(columns), "dropped_for_range": dropped, "unseen_rates": rates,
        "dropout_probe": {("on" if k else "off"): v for k, v in probe.items()}, "identity_dropout": use, "holdout_ap": scores, "predictor": predictor,
        "trees": trees, "final_trees": final, "seeds": max(1, options.seeds), "top_features": models.importances(next(iter(kept.values())), columns),
        "positive_rate": float(matrix.agg(F.avg("target")).first()[0]), "holdout_ap_natural": _natural(fitted, natural, encoded_train, columns),
    }
    return ClusterModel(cluster, columns, fills, encoder["prior"], encoder["stats"], encoder["codes"], kept, seconds, predictor), report


def _natural(fitted: dict[str, models.Model], natural: DataFrame, train: DataFrame, columns: list[str]) -> dict[str, float]:
    """Average precisions on the held-out jobs as they are."""
    rows = models.design(natural, columns, models.medians(train, columns))[0]
    out = {name: _ap(natural, _blended(rows, {name: model})) for name, model in fitted.items()}
    return out | ({BLEND: _ap(natural, _blended(rows, fitted))} if len(fitted) > 1 else {})


def _encoder(rows: DataFrame) -> dict:
    return {"prior": float(rows.agg(F.avg("target")).first()[0] or 0.0), "stats": materialise(encoding.target_stats(rows), "stats"), "codes": materialise(encoding.label_codes(rows), "codes")}


def _encoded_training(rows: DataFrame, encoder: dict) -> DataFrame:
    """Training rows with encodings that each month takes from the months before it."""
    return encoding.with_codes(rows, encoder["codes"]).join(encoding.wide(encoding.te_expanding(rows)), "jid", "left")


def _encoded(rows: DataFrame, encoder: dict) -> DataFrame:
    """Rows that come after all training ones, with encodings from all of these."""
    encoded = encoding.wide(encoding.with_statistics(rows, encoder["stats"], F.lit(encoder["prior"])))
    return encoding.with_codes(rows, encoder["codes"]).join(encoded, "jid", "left")


def predict_clusters(spark: SparkSession, matrices: dict[str, DataFrame], models_path: str) -> DataFrame:
    """(row_id, score) of every cluster's jobs, each scored by the model of its own cluster; a job twice is an error."""
    out = None
    for cluster, matrix in matrices.items():
        if not matrix.groupBy("jid").count().filter("count > 1").isEmpty():
            raise ValueError(f"{cluster}: a job occurs twice among those to be scored")
        scores = ClusterModel.load(spark, models_path, cluster).predict(matrix)
        scores = scores.select(row_id(F.lit(cluster), F.col("jid")).alias("row_id"), "score")
        out = scores if out is None else out.unionByName(scores)
    if out is None:
        raise ValueError("no cluster has jobs to be scored")
    return out
