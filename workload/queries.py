"""Spark side of the workload: one callable (spark, sf_dir) per query."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import parse_ts, purity, stringify_ts, unreadable_times
from tidewatch.ml.quantile import exact_quantile
from tidewatch.ml.regression import fit_regression, predict
from tidewatch.ml.silhouette import silhouette
from tidewatch.operators import access as ac
from tidewatch.operators import accounts as acc
from tidewatch.operators import calls as ca
from tidewatch.operators import graph as gr
from tidewatch.operators import heatmap as hm
from tidewatch.operators import report as rp
from tidewatch.operators import roles as ro
from tidewatch.operators import similarity as si
from tidewatch.plans import access as access_plans
from tidewatch.plans import calls as call_plans
from tidewatch.plans import report as report_plans
from tidewatch.session import materialise, scratch_root
from tidewatch.sources import load_baseline, load_unified, save_baseline, save_unified
from tidewatch.sources.files import save_baseline_snapshot

from . import views

Query = Callable[[SparkSession, str], DataFrame]

# Report range, drill-down names, and the split between history and batch.
RANGE = ("2024-01-05", "2024-01-25")
DRILL_USER, DRILL_ACCOUNT = "u7", "ACCT42"
BATCH_START = "2024-01-21"
LAST_WEEK, LAST_DAY = "2024-01-29", "2024-01-30"
HISTORY_END = "1999-01-01"
COMPARE_SPLIT = "2024-01-16"
FLAG_COLUMNS = ["user", "_time", "uid", "remote_address", "device_ip_address", "cmd_group", *ac.FLAGS]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the double columns, whose sums depend on their order."""
    return df.select(*[
        F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])


# ---------------------------------------------------------------- report

def report(spark, d):
    return rp.attach_unique_accounts(views.calls(spark, d).drop("source_file"))


def users_by_day(spark, d):
    return rp.users_by_day(rp.filter_range(views.calls(spark, d), *RANGE))


def users_by_day_default(spark, d):
    return report_plans.date_filter(views.calls(spark, d))[1]


def user_drill(spark, d):
    return report_plans.user_drill_in_range(views.calls(spark, d).drop("source_file"), DRILL_USER, *RANGE)


def account_drill(spark, d):
    return report_plans.account_drill_in_range(views.calls(spark, d).drop("source_file"), DRILL_ACCOUNT, *RANGE)


def unique_accounts(spark, d):
    return stringify_ts(report(spark, d), ("dttm",))


def date_bounds(spark, d):
    return rp.date_bounds(views.calls(spark, d))


# ---------------------------------------------------------------- call metrics

def daily(spark, d):
    return ca.daily_rows(views.calls(spark, d))


def baseline(spark, d):
    return ca.baseline(daily(spark, d), LAST_WEEK)


def deviations(cold_start: str) -> Query:
    def run(spark, d):
        rows = daily(spark, d)
        today = rows.where(F.col("date") == F.lit(LAST_DAY).cast("date"))
        return ca.deviations(today, ca.baseline(rows, LAST_WEEK), cold_start)
    return run


def first_day_deviations(cold_start: str) -> Query:
    """The first week has no history, so the policy decides every row."""
    def run(spark, d):
        return ca.historic_deviations(daily(spark, d), cold_start)
    return run


def backfill(spark, d):
    return call_plans.metrics_of_days(views.calls(spark, d))


def backfill_parts(spark, d):
    """Several files per day, one of them with calls of the day before."""
    return call_plans.metrics_of_days(views.call_parts(spark, d))


def parsed_times(spark, d):
    return views.time_texts(spark, d).withColumn("seen_at", parse_ts("seen"))


def unreadable(spark, d):
    return unreadable_times(views.time_texts(spark, d), "seen")


def average_matrix(spark, d):
    return hm.average_week(ca.hour_counters(views.calls(spark, d)), LAST_WEEK)


def deviation_matrix(spark, d):
    counters = materialise(ca.hour_counters(views.calls(spark, d)), "hour-counters")
    return hm.deviation_week(counters, LAST_WEEK, LAST_DAY)


def average_matrix_of_rows(spark, d):
    """The matrix from stored average rows, as the unified table holds them."""
    return hm.average_matrix(baseline(spark, d), "average total calls")


def deviation_matrix_of_rows(spark, d):
    return hm.deviation_matrix(deviations("suppress")(spark, d), LAST_DAY, "total calls deviation")


def run_daily(spark, d):
    """All days up to the last week at once, then its days one after another on the running state."""
    calls = views.calls(spark, d)
    out = f"{scratch_root(spark)}/tidewatch/daily-{uuid.uuid4().hex}"
    call_plans.add_days(spark, calls.where(F.col("source_file") < LAST_WEEK), out)
    last = [r["source_file"] for r in calls.where(F.col("source_file") >= LAST_WEEK).select("source_file").distinct().collect()]
    for day in sorted(last):
        table = call_plans.add_day(spark, calls.where(F.col("source_file") == day), out)
    return table


def daily_tuesday(spark, d):
    """Weeks that begin on Tuesday."""
    return ca.daily_rows(views.calls(spark, d), week_anchor="tuesday")


def no_status_deviations(spark, d):
    return ca.historic_deviations(daily(spark, d), "suppress", include_active=False)


# ---------------------------------------------------------------- heatmaps and profiles

def role_heatmap(mode: str) -> Query:
    return lambda spark, d: hm.role_heatmap(views.commands(spark, d), "human", mode)


def compare_roles(spark, d):
    return hm.compare_roles(views.commands(spark, d), "row")


def compare_roles_absent(spark, d):
    """A role without events has a matrix of zeros."""
    return hm.compare_roles(views.commands(spark, d), "row", ("human", "functional", "robot"))


def induced(spark, d):
    """Strong edges among the 40 users of highest degree."""
    features = gr.user_features(views.similarity_log(spark, d), keep_nulls=True)
    nodes = gr.top_nodes(gr.weighted_degree(features), 40)
    nodes = materialise(nodes, "top-nodes")
    return rounded(gr.induced_subgraph(gr.threshold_edges(gr.projected_edges(features, among=nodes), 20), nodes))


def top_users(spark, d):
    return hm.top_users(views.commands(spark, d), "functional", 6)


def top_user_heatmap(spark, d):
    return hm.top_user_heatmaps(views.commands(spark, d), "human", 6, "global")


def role_props(spark, d):
    log = views.commands(spark, d)
    return ro.role_counts(log).join(ro.role_proportions(log), "command")


def hour_profile(spark, d):
    return ro.hour_profile(views.commands(spark, d))


def role_clusters(spark, d):
    found = ro.role_clusters(views.commands(spark, d))
    return rounded(found.rows.withColumns({
        c: found.stats.select(c).scalar() for c in found.stats.columns
    }))


def purity_tables(spark, d):
    return rounded(ro.purity_tables(ro.role_clusters(views.commands(spark, d)).rows, 8))


def hour_clusters(spark, d):
    found = ro.hour_clusters(views.commands(spark, d))
    return rounded(found.rows.withColumn("silhouette", found.stats.scalar()))


def cluster_usage(spark, d):
    log = views.commands(spark, d)
    return hm.cluster_usage(log, ro.hour_clusters(log, pca=False).rows)


def cluster_hour_mean(spark, d):
    log = views.commands(spark, d)
    return rounded(hm.cluster_hour_mean(ro.hour_profile(log), ro.hour_clusters(log, pca=False).rows))


def labelled_props(spark, d):
    """Role proportions with the kind of event in a command as its cluster."""
    kind = F.split("command", " ")[0]
    label = F.lit(None).cast("int")
    for i, name in enumerate(views.COMMANDS):
        label = F.when(kind == name, i).otherwise(label)
    props = ro.role_proportions(views.commands(spark, d)).withColumn("cluster", label)
    return props.withColumn("purity", purity("human_prop", "functional_prop"))


def labelled_usage(spark, d):
    return hm.cluster_usage(views.commands(spark, d), labelled_props(spark, d))


def labelled_hour_mean(spark, d):
    return rounded(hm.cluster_hour_mean(ro.hour_profile(views.commands(spark, d)), labelled_props(spark, d)))


def labelled_purity(spark, d):
    return ro.purity_tables(labelled_props(spark, d), 8)


def labelled_stats(spark, d):
    return rounded(ro.cluster_stats(labelled_props(spark, d)))


def labelled_silhouette(spark, d):
    points = labelled_props(spark, d).select(F.array("human_prop", "functional_prop").alias("point"), "cluster")
    return rounded(silhouette(points))


def labelled_silhouette_squared(spark, d):
    points = labelled_props(spark, d).select(F.array("human_prop", "functional_prop").alias("point"), "cluster")
    return rounded(silhouette(points, exact=False))


def price_quantiles(spark, d):
    prices = views.table(spark, d, "lineitem").select("l_extendedprice")
    found = [(q, exact_quantile(prices, "l_extendedprice", q, 1000)) for q in (0.01, 0.5, 0.999)]
    return rounded(spark.createDataFrame(found, "q double, price double"))


def compare(spark, d):
    log = views.commands(spark, d)
    split = F.lit(COMPARE_SPLIT).cast("timestamp_ntz")
    early, late = log.where(F.col("timestamp") < split), log.where(F.col("timestamp") >= split)
    return rounded(ro.compare(early, late)["summary"])


def compare_squared(spark, d):
    """The same without pairs of commands."""
    log = views.commands(spark, d)
    split = F.lit(COMPARE_SPLIT).cast("timestamp_ntz")
    early, late = log.where(F.col("timestamp") < split), log.where(F.col("timestamp") >= split)
    return rounded(ro.compare(early, late, exact=False)["summary"])


# ---------------------------------------------------------------- access

def clean(spark, d):
    return ac.preprocess_access(views.access(spark, d))


def cmd_group(spark, d):
    return clean(spark, d).select("uid", "user", "cmd", "cmd_group", "event_date")


def novelty_train(spark, d):
    return ac.expand_copies(ac.novelty_history(clean(spark, d))).select(*FLAG_COLUMNS)


def split_history(spark, d):
    events = clean(spark, d)
    start = F.lit(BATCH_START).cast("date")
    return events.where(F.col("event_date") < start), events.where(F.col("event_date") >= start)


def seeded_baseline(spark, d):
    empty = spark.createDataFrame([], "user string, kind string, v1 string, v2 string, as_of date")
    return ac.update_baseline(empty, split_history(spark, d)[0], "2024-01-20")


def novelty_infer(spark, d):
    return ac.novelty_baseline(split_history(spark, d)[1], seeded_baseline(spark, d)).select(*FLAG_COLUMNS)


def known_keys(spark, d):
    return ac.known_keys(clean(spark, d))


def baseline_update(spark, d):
    return ac.update_baseline(seeded_baseline(spark, d), split_history(spark, d)[1], "2024-01-30")


def baseline_roundtrip(spark, d):
    """Known keys of two days stored, one of them twice, and read back."""
    path = f"{scratch_root(spark)}/tidewatch/stored-keys-{uuid.uuid4().hex}"
    old = seeded_baseline(spark, d)
    save_baseline(old, path)
    for _ in range(2):
        before = load_baseline(spark, path).where(F.col("as_of") < "2024-01-30")
        save_baseline(materialise(ac.new_baseline_keys(before, split_history(spark, d)[1], "2024-01-30"), "new-keys"), path)
    return load_baseline(spark, path)


def unified_roundtrip(spark, d):
    """The unified table of all days stored, its last days stored again, and read back."""
    path = f"{scratch_root(spark)}/tidewatch/stored-metrics-{uuid.uuid4().hex}"
    rows = materialise(backfill(spark, d), "all-metrics")
    dated = rows.where(F.col("date").isNotNull())
    save_unified(dated, path)
    save_unified(dated.where(F.col("date") > LAST_WEEK), path)
    save_baseline_snapshot(rows.where(F.col("date").isNull()), path)
    return load_unified(spark, path)


def policy(spark, d):
    return ac.policy_features(clean(spark, d), views.rules(spark, d)).select(
        "uid", "user", "policy_status", "policy_risk", "control_gap_risk", "best_rule_id", "matched_rule_id",
        *[f"{f}_{s}" for s in ("violation", "unknown") for f in ac.POLICY_FIELDS],
    )


def event_features(spark, d):
    return ac.event_risk(ac.policy_features(ac.novelty_history(clean(spark, d)), views.rules(spark, d)))


def event_risk(spark, d):
    return event_features(spark, d).select("uid", "user", "event_risk", "event_risk_norm")


def event_risk_basic(spark, d):
    return ac.event_risk_basic(ac.novelty_history(clean(spark, d))).select("uid", "user", "event_risk", "event_risk_norm")


def user_days(spark, d):
    rows = ac.policy_features(ac.novelty_history(clean(spark, d), by_event=False), views.rules(spark, d))
    return ac.user_day_features(ac.event_risk(rows))


def user_day(spark, d):
    return rounded(user_days(spark, d))


def user_day_by_event(spark, d):
    return rounded(ac.user_day_features(event_features(spark, d)))


def user_day_counts(spark, d):
    rows = ac.event_risk_basic(ac.novelty_history(clean(spark, d), by_event=False))
    return rounded(ac.user_day_features(rows, counts=True))


def daily_graph(spark, d):
    return gr.daily_graph_features(views.similarity_log(spark, d), ["_time"])


def full_user_days(spark, d):
    return access_plans.training_user_days(
        clean(spark, d), daily_graph(spark, d), views.rules(spark, d), access_plans.AccessConfig()
    )


def graph_daily(spark, d):
    return rounded(daily_graph(spark, d))


def graph_merge(spark, d):
    return rounded(full_user_days(spark, d).select(
        "user", "event_date", "entropy_norm", "degree_norm", "clustering_coeff"
    ))


def warmup(spark, d):
    return ac.warmup(user_days(spark, d)).select(
        "user", "event_date", "user_type", "days_since_first_seen", "warmup_days_required", "is_warmup"
    )


def train_human(spark, d):
    chosen = ac.human_training_set(full_user_days(spark, d))
    return rounded(chosen.select("user", "event_date", *access_plans.HUMAN_FEATURES))


def train_functional(spark, d):
    chosen = ac.functional_training_set(full_user_days(spark, d))
    return rounded(chosen.select("user", "event_date", *access_plans.FUNCTIONAL_FEATURES))


def reasons(spark, d):
    return ac.explain(full_user_days(spark, d)).select("user", "event_date", F.array_join("reasons", "; ").alias("reasons"))


def reasons_basic(spark, d):
    days = access_plans.basic_user_days(clean(spark, d), daily_graph(spark, d), access_plans.AccessConfig())
    return ac.explain(days, ac.REASONS_BASIC).select("user", "event_date", F.array_join("reasons", "; ").alias("reasons"))


SCORED_COLUMNS = [
    "user", "event_date", "user_type", "total_events", "iforest_score", "iforest_pred", "is_anomaly", "model_type",
]


def scored_days(spark, d):
    """Train on the whole log, then score the batch against the earlier days' baseline."""
    raw, rules = views.access(spark, d), views.rules(spark, d)
    graph = materialise(daily_graph(spark, d), "daily-graph")
    models, _ = access_plans.train(raw, graph, rules)
    batch = raw.where(F.col("_time") >= F.lit(BATCH_START).cast("timestamp_ntz"))
    tables = access_plans.infer(batch, graph, rules, models, seeded_baseline(spark, d))
    return tables["scored_user_days"].select(
        *SCORED_COLUMNS, "direct_policy_alert", F.array_join("reasons", "; ").alias("reasons")
    )


def one_shot(spark, d):
    tables = access_plans.one_shot(views.access(spark, d), daily_graph(spark, d))
    return tables["scored_user_days"].select(*SCORED_COLUMNS, F.array_join("reasons", "; ").alias("reasons"))


# ---------------------------------------------------------------- graph

def features(spark, d):
    return gr.user_features(views.similarity_log(spark, d))


def similarity_log_with_gaps(spark, d):
    """Purchases come without a network and keywords."""
    gap = F.col("cmd_keywords").startswith("purchase")
    return views.similarity_log(spark, d).withColumns({
        c: F.when(~gap, F.col(c)) for c in ("remote_network", "cmd_keywords")
    })


def user_features(keep_nulls: bool) -> Query:
    return lambda spark, d: gr.user_features(similarity_log_with_gaps(spark, d), keep_nulls=keep_nulls)


def types(spark, d):
    return gr.last_type(views.similarity_log(spark, d), ["_time"])


def graph_edges(spark, d):
    return gr.projected_edges(features(spark, d))


def graph_degree(spark, d):
    return gr.weighted_degree(features(spark, d))


def graph_entropy(spark, d):
    return rounded(gr.neighbor_type_entropy(features(spark, d), types(spark, d)).drop("degree"))


def graph_clustering(spark, d):
    return rounded(gr.weighted_clustering(features(spark, d)))


def graph_features(spark, d):
    return rounded(gr.graph_features(views.similarity_log(spark, d), ["_time"]))


def graph_sample_nodes(spark, d):
    return rounded(gr.graph_sample(views.similarity_log(spark, d), ["_time"])[0])


def graph_sample_edges(spark, d):
    return rounded(gr.graph_sample(views.similarity_log(spark, d), ["_time"], n=50, min_weight=20)[1])


# ---------------------------------------------------------------- similarity, accounts, regression

def similarity(spark, d):
    parts = views.ordered_parts(spark, d)
    past = F.col("o_orderdate") < F.lit(HISTORY_END).cast("timestamp_ntz")
    history = si.history_counts(parts.where(past))
    wanted = parts.where(~past).select("user", F.col("command").alias("cleaned_command"))
    # Ratios of small whole numbers often end at the seventh digit, hence nine.
    return rounded(si.similarity_anomalies(wanted, history), 9)


def directory_match(spark, d):
    return acc.in_directory(views.accounts(spark, d), views.directory(spark, d)).select("c_custkey", "user", "in_directory")


def curate(spark, d):
    curated = acc.curate_accounts(views.accounts(spark, d), views.directory(spark, d))
    return curated.select(
        "c_custkey", "user", "is_functional", "user_type", acc.to_pipeline_type("user_type").alias("pipeline_type")
    )


def regression(spark, d):
    items = views.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice"
    )
    model = fit_regression(items, ["l_quantity", "l_discount"], "l_extendedprice")
    return predict(model, items).select("l_orderkey", "l_linenumber", F.round("prediction", 2).alias("prediction"))


QUERIES: dict[str, Query] = {
    "q_users_by_day": users_by_day,
    "q_users_by_day_default": users_by_day_default,
    "q_user_drill": user_drill,
    "q_account_drill": account_drill,
    "q_unique_accounts": unique_accounts,
    "q_date_bounds": date_bounds,
    "q_daily_rows": daily,
    "q_baseline": baseline,
    "q_deviations_suppress": deviations("suppress"),
    "q_deviations_zero": deviations("zero"),
    "q_deviations_nan": deviations("nan"),
    "q_history_zero": first_day_deviations("zero"),
    "q_history_nan": first_day_deviations("nan"),
    "q_backfill": backfill,
    "q_backfill_parts": backfill_parts,
    "q_parse_times": parsed_times,
    "q_unreadable_times": unreadable,
    "q_daily_rows_tuesday": daily_tuesday,
    "q_history_no_status": no_status_deviations,
    "q_avg_matrix": average_matrix,
    "q_dev_matrix": deviation_matrix,
    "q_avg_matrix_of_rows": average_matrix_of_rows,
    "q_dev_matrix_of_rows": deviation_matrix_of_rows,
    "q_run_daily": run_daily,
    "q_role_heatmap_none": role_heatmap("none"),
    "q_role_heatmap_global": role_heatmap("global"),
    "q_role_heatmap_row": role_heatmap("row"),
    "q_role_heatmap_col": role_heatmap("col"),
    "q_compare_roles": compare_roles,
    "q_compare_roles_absent": compare_roles_absent,
    "q_induced_subgraph": induced,
    "q_top_users": top_users,
    "q_top_user_heatmap": top_user_heatmap,
    "q_role_props": role_props,
    "q_hour_profile": hour_profile,
    "q_role_clusters": role_clusters,
    "q_purity_tables": purity_tables,
    "q_hour_clusters": hour_clusters,
    "q_cluster_heatmap": cluster_usage,
    "q_cluster_hour_mean": cluster_hour_mean,
    "q_labelled_usage": labelled_usage,
    "q_labelled_hour_mean": labelled_hour_mean,
    "q_labelled_purity": labelled_purity,
    "q_labelled_stats": labelled_stats,
    "q_labelled_silhouette": labelled_silhouette,
    "q_labelled_silhouette_squared": labelled_silhouette_squared,
    "q_price_quantiles": price_quantiles,
    "q_compare": compare,
    "q_compare_squared": compare_squared,
    "q_cmd_group": cmd_group,
    "q_novelty_train": novelty_train,
    "q_novelty_infer": novelty_infer,
    "q_known_keys": known_keys,
    "q_baseline_update": baseline_update,
    "q_baseline_roundtrip": baseline_roundtrip,
    "q_unified_roundtrip": unified_roundtrip,
    "q_policy": policy,
    "q_event_risk": event_risk,
    "q_event_risk_basic": event_risk_basic,
    "q_user_day": user_day,
    "q_user_day_by_event": user_day_by_event,
    "q_user_day_counts": user_day_counts,
    "q_graph_daily": graph_daily,
    "q_graph_merge": graph_merge,
    "q_warmup": warmup,
    "q_train_human": train_human,
    "q_train_functional": train_functional,
    "q_reasons": reasons,
    "q_reasons_basic": reasons_basic,
    "q_scored_days": scored_days,
    "q_one_shot": one_shot,
    "q_user_features": user_features(False),
    "q_user_features_nulls": user_features(True),
    "q_user_types": types,
    "q_graph_edges": graph_edges,
    "q_graph_degree": graph_degree,
    "q_graph_entropy": graph_entropy,
    "q_graph_clustering": graph_clustering,
    "q_graph_features": graph_features,
    "q_graph_sample_nodes": graph_sample_nodes,
    "q_graph_sample_edges": graph_sample_edges,
    "q_similarity": similarity,
    "q_directory_match": directory_match,
    "q_curate": curate,
    "q_regression": regression,
}
