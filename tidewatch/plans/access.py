"""Access-anomaly training, daily inference and the one-shot run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import (
    BASIC_RISK_CEILING, FUNCTIONAL_FEATURES, FUNCTIONAL_FEATURES_BASIC, HUMAN_FEATURES, AccessConfig,
)
from ..ml.forest import IsolationForest, IsolationForestModel
from ..operators.access import (
    REASONS_BASIC, REASONS_WITH_POLICY, direct_policy_alert, event_risk, explain,
    functional_training_set, human_training_set, merge_graph_features, new_baseline_keys,
    novelty_baseline, novelty_history, policy_features, preprocess_access, user_day_features, warmup,
)
from ..session import materialise
from ..sources.files import load_baseline, load_models, save_baseline, save_models

ROW_KEY = ["user", "event_date"]


@dataclass(frozen=True)
class Models:
    human: IsolationForestModel
    functional: IsolationForestModel


def training_user_days(events: DataFrame, graph: DataFrame, rules: DataFrame | None, cfg: AccessConfig) -> DataFrame:
    """User-day features of clean events against their own history.

    Works on activity groups, so events are shuffled once, already combined.
    """
    rows = event_risk(policy_features(novelty_history(events, by_event=False), rules))
    return warmup(merge_graph_features(user_day_features(rows), graph), cfg)


def batch_user_days(
    events: DataFrame, graph: DataFrame, rules: DataFrame | None, baseline: DataFrame, cfg: AccessConfig
) -> DataFrame:
    """User-day features of a batch against the stored baseline."""
    rows = event_risk(policy_features(novelty_baseline(events, baseline, by_event=False), rules))
    return warmup(merge_graph_features(user_day_features(rows), graph), cfg)


def basic_user_days(events: DataFrame, graph: DataFrame, cfg: AccessConfig) -> DataFrame:
    """User-day features without policy, with flag counts."""
    rows = event_risk(novelty_history(events, by_event=False), BASIC_RISK_CEILING, cap=False)
    return warmup(merge_graph_features(user_day_features(rows, BASIC_RISK_CEILING, counts=True), graph), cfg)


def fit_models(user_days: DataFrame, functional_features: list[str], cfg: AccessConfig) -> Models:
    """One forest per user type on its training set; an empty set is an error."""
    human = IsolationForest(cfg.n_trees, cfg.human.contamination, cfg.seed)
    functional = IsolationForest(cfg.n_trees, cfg.functional.contamination, cfg.seed)
    return Models(
        human.fit(human_training_set(user_days, cfg), HUMAN_FEATURES, ROW_KEY),
        functional.fit(functional_training_set(user_days, cfg), functional_features, ROW_KEY),
    )


def score_user_days(user_days: DataFrame, models: Models) -> tuple[DataFrame, DataFrame]:
    """Score each user type with its own forest; other types are not scored."""
    of_type = F.col("user_type")
    return (
        models.human.score(user_days.where(of_type == "human"), "human_iforest"),
        models.functional.score(user_days.where(of_type == "functional"), "functional_iforest"),
    )


def _most_anomalous_first(df: DataFrame) -> DataFrame:
    return df.orderBy("iforest_score", "user", "event_date")


def train(
    raw: DataFrame, graph: DataFrame, rules: DataFrame | None, cfg: AccessConfig = AccessConfig()
) -> tuple[Models, dict[str, DataFrame]]:
    """Fit both forests on the history in ``raw``; the tables used are returned too."""
    clean = preprocess_access(raw, cfg)
    user_days = materialise(training_user_days(clean, graph, rules, cfg), "training-user-days")
    models = fit_models(user_days, FUNCTIONAL_FEATURES, cfg)
    return models, {
        "clean_events": clean,
        "event_features": event_risk(policy_features(novelty_history(clean), rules)),
        "user_day_features": user_days,
        "human_train": human_training_set(user_days, cfg),
        "functional_train": functional_training_set(user_days, cfg),
    }


def infer(
    raw: DataFrame, graph: DataFrame, rules: DataFrame | None, models: Models, baseline: DataFrame,
    cfg: AccessConfig = AccessConfig(),
) -> dict[str, DataFrame]:
    """Score a batch against stored models and baseline. Nothing runs until a table is used."""
    clean = preprocess_access(raw, cfg)
    user_days = batch_user_days(clean, graph, rules, baseline, cfg)
    human, functional = score_user_days(user_days, models)
    scored = human.unionByName(direct_policy_alert(functional), allowMissingColumns=True)
    return {
        "clean_events": clean,
        "event_features": event_risk(policy_features(novelty_baseline(clean, baseline), rules)),
        "user_day_features": user_days,
        "scored_user_days": _most_anomalous_first(explain(scored, REASONS_WITH_POLICY)),
    }


def one_shot(raw: DataFrame, graph: DataFrame, cfg: AccessConfig = AccessConfig()) -> dict[str, DataFrame]:
    """Train and score on the same log, without policy."""
    clean = preprocess_access(raw, cfg)
    user_days = materialise(basic_user_days(clean, graph, cfg), "one-shot-user-days")
    if user_days.isEmpty():
        raise ValueError("no user-day rows")
    models = fit_models(user_days, FUNCTIONAL_FEATURES_BASIC, cfg)
    human, functional = score_user_days(user_days, models)
    scored = human.unionByName(functional, allowMissingColumns=True)
    return {
        "clean_events": clean,
        "event_features": event_risk(novelty_history(clean), BASIC_RISK_CEILING, cap=False),
        "user_day_features": user_days,
        "human_train": human_training_set(user_days, cfg),
        "functional_train": functional_training_set(user_days, cfg),
        "scored_user_days": _most_anomalous_first(explain(scored, REASONS_BASIC)),
    }


def train_and_save(
    spark: SparkSession, raw: DataFrame, graph: DataFrame, rules: DataFrame | None, model_path: str,
    cfg: AccessConfig = AccessConfig(),
) -> dict[str, DataFrame]:
    """The periodic job: fit and store the models. The baseline is not touched."""
    models, tables = train(raw, graph, rules, cfg)
    save_models(spark, models.human, models.functional, model_path)
    return tables


def infer_and_update(
    spark: SparkSession, raw: DataFrame, graph: DataFrame, rules: DataFrame | None, model_path: str,
    baseline_path: str, as_of, cfg: AccessConfig = AccessConfig(),
) -> dict[str, DataFrame]:
    """The daily job: score with stored models, then add the batch's keys to the baseline.

    Scores are written out before the baseline changes. Only keys stored
    before ``as_of`` count as known, so running any day again gives the same
    result.
    """
    stored = load_baseline(spark, baseline_path)
    before = stored.where(F.col("as_of").isNull() | (F.col("as_of") < F.lit(as_of).cast("date")))
    models = Models(*load_models(spark, model_path))
    tables = infer(raw, graph, rules, models, before, cfg)
    scored = materialise(tables["scored_user_days"], "scored-user-days")
    added = materialise(new_baseline_keys(before, tables["clean_events"], as_of), "baseline-keys")
    save_baseline(added, baseline_path)
    return tables | {"scored_user_days": _most_anomalous_first(scored)}
