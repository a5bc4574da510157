"""Access events: cleaning, novelty, policy, risk, user-day features, reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import (
    BASIC_RISK_CEILING, NOVELTY_WEIGHTS, POLICY_RISK_CEILING, UNKNOWN_WEIGHTS,
    VIOLATION_WEIGHTS, AccessConfig, RoleLimits,
)
from ..functions import cap_at_one, normalize_command, parse_allowlist, parse_ts, reason
from ..schemas import GRAPH_FEATURE_COLUMNS, RULE_COLUMNS, require_columns

EVENT_COLUMNS = [
    "user", "_time", "uid", "remote_address", "device_ip_address", "cmd", "user_type",
    "cmd_group", "event_date",
]
IDENTITY = ["user", "_time", "uid", "device_ip_address", "remote_address", "cmd", "user_type"]
COMBINATION = ["user", "remote_address", "device_ip_address", "cmd_group"]
MISSING_TEXT = "nan"
COPY_CHUNK = 65_536

# Which columns make up each kind of known key, and the flag for a new one.
KEY_KINDS = {
    "remote": ("remote_address", None, "new_remote"),
    "device": ("device_ip_address", None, "new_device"),
    "cmd": ("cmd_group", None, "new_command"),
    "remote_cmd": ("remote_address", "cmd_group", "new_remote_cmd_pair"),
    "device_cmd": ("device_ip_address", "cmd_group", "new_device_cmd_pair"),
}
FLAGS = [flag for _, _, flag in KEY_KINDS.values()]
RULE_SALTS = 16
POLICY_FIELDS = {"remote": "remote_address", "device": "device_ip_address", "command": "cmd_group"}


# ---------------------------------------------------------------- cleaning

def preprocess_access(raw: DataFrame, cfg: AccessConfig = AccessConfig()) -> DataFrame:
    """Clean events: readable time and user required, text columns, command group, date.

    Other missing text becomes the token ``nan``, which compares like a value.
    """
    texts = ["uid", "remote_address", "device_ip_address", "cmd", "user_type"]
    require_columns(raw, [cfg.source(c) for c in ("user", "_time", *texts)], "access events")
    user = F.col(cfg.source("user"))
    return raw.where(user.isNotNull()).select(
        user.cast("string").alias("user"),
        parse_ts(cfg.source("_time"), *cfg.time_formats).alias("_time"),
        *[F.coalesce(F.col(cfg.source(c)).cast("string"), F.lit(MISSING_TEXT)).alias(c) for c in texts],
        normalize_command(cfg.source("cmd")).alias("cmd_group"),
    ).where(F.col("_time").isNotNull()).withColumn("event_date", F.to_date("_time"))


def activity_groups(events: DataFrame) -> DataFrame:
    """Events of one user, day, host pair, command group and type as one row.

    ``weight`` counts the events; time, uid and cmd are those of the earliest.
    Everything user-day features need depends only on these columns, so the
    event table is combined before its only shuffle.
    """
    keys = ["user", "event_date", "remote_address", "device_ip_address", "cmd_group", "user_type"]
    grouped = events.groupBy(*keys).agg(
        F.count("*").alias("weight"), F.min(F.struct("_time", "uid", "cmd")).alias("first")
    )
    return grouped.select(*keys, "first._time", "first.uid", "first.cmd", "weight")


def identical_events(events: DataFrame) -> DataFrame:
    """Exact copies of an event as one row, counted in ``weight``."""
    return events.groupBy(*EVENT_COLUMNS).agg(F.count("*").alias("weight"))


def expand_copies(rows: DataFrame) -> DataFrame:
    """One row per event again, from rows counted in ``weight``.

    Copies are numbered in chunks, so no long array arises for a row with very many.
    """
    chunk, size = F.col("chunk"), F.lit(COPY_CHUNK).cast("long")
    last = F.least(size, F.col("weight") - chunk * size)
    return (
        rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("weight") - 1) / size))))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), last)))
        .drop("chunk", "copy", "weight")
    )


# ---------------------------------------------------------------- novelty

def _kind_rows() -> Column:
    none = F.lit(None).cast("string")
    return F.array(*[
        F.struct(
            F.lit(kind).alias("kind"), F.col(a).alias("v1"), (F.col(b) if b else none).alias("v2")
        )
        for kind, (a, b, _) in KEY_KINDS.items()
    ])


def first_sightings(groups: DataFrame) -> DataFrame:
    """Events that show a user some key for the first time, with their flags.

    The earliest event of each key comes from a combined minimum, never from
    ordering one user's whole history in a task.
    """
    order = ["_time", "uid", "device_ip_address", "remote_address", "cmd", "user_type"]
    firsts = (
        # True for every row; reading the weight keeps this aggregate identical to
        # the one the flags are joined to, so its shuffle is done once and reused.
        groups.where(F.col("weight") > 0)
        .select("user", F.struct(*order).alias("event"), F.explode(_kind_rows()).alias("key"))
        .groupBy("user", "key.kind", "key.v1", "key.v2").agg(F.min("event").alias("event"))
    )
    flags = [
        F.max((F.col("kind") == kind).cast("int")).alias(flag)
        for kind, (_, _, flag) in KEY_KINDS.items()
    ]
    return firsts.groupBy("user", "event").agg(*flags).select("user", "event.*", *FLAGS)


def novelty_history(events: DataFrame, by_event: bool = True) -> DataFrame:
    """Flag, per user in (time, uid) order, the first sight of each kind of key.

    Rows carry ``weight`` events each: one row per distinct event, or per
    activity group when ``by_event`` is false. A flag belongs to one event, so
    a flagged row of several events is split into that event and the rest.
    """
    groups = activity_groups(events)
    rows = identical_events(events) if by_event else groups.where(F.col("weight") > 0)
    joined = rows.join(first_sightings(groups), IDENTITY, "left")
    flagged = F.struct(F.lit(1).cast("long").alias("weight"), *[F.coalesce(F.col(f), F.lit(0)).alias(f) for f in FLAGS])
    rest = F.struct((F.col("weight") - 1).alias("weight"), *[F.lit(0).alias(f) for f in FLAGS])
    plain = F.struct(F.col("weight"), *[F.lit(0).alias(f) for f in FLAGS])
    parts = (
        F.when(F.col(FLAGS[0]).isNull(), F.array(plain))
        .when(F.col("weight") > 1, F.array(flagged, rest))
        .otherwise(F.array(flagged))
    )
    kept = [c for c in rows.columns if c != "weight"]
    return joined.select(*kept, F.inline(parts))


def known_keys(events: DataFrame) -> DataFrame:
    """Distinct (user, kind, v1, v2) keys of the events."""
    combos = events.select(*COMBINATION).distinct()
    return combos.select("user", F.inline(_kind_rows())).distinct()


def _same_key(left: DataFrame, right: DataFrame) -> Column:
    blank = F.lit("")
    return (
        (left["user"] == right["user"]) & (left["kind"] == right["kind"]) & (left["v1"] == right["v1"])
        & (F.coalesce(left["v2"], blank) == F.coalesce(right["v2"], blank))
    )


def unseen_flags(rows: DataFrame, baseline: DataFrame, keep: list[str]) -> DataFrame:
    """Flag each row's five keys that ``baseline`` lacks; ``keep`` identifies a row.

    One join covers all five kinds, and one grouping brings the flags back.
    """
    keyed = rows.select(*keep, F.inline(_kind_rows()))
    known = baseline.select("user", "kind", "v1", "v2").distinct()
    known = known.select(*[F.col(c).alias(c) for c in known.columns], F.lit(1).alias("seen"))
    joined = keyed.join(known, _same_key(keyed, known), "left").select(
        *[keyed[c] for c in keep], keyed["kind"], known["seen"]
    )
    flags = [
        F.max(F.when((F.col("kind") == kind) & F.col("seen").isNull(), 1).otherwise(0)).alias(flag)
        for kind, (_, _, flag) in KEY_KINDS.items()
    ]
    return joined.groupBy(*keep).agg(*flags)


def novelty_baseline(events: DataFrame, baseline: DataFrame, by_event: bool = True) -> DataFrame:
    """Flag every event whose key the stored baseline lacks."""
    if not by_event:
        groups = activity_groups(events)
        return unseen_flags(groups, baseline, groups.columns)
    combos = events.select(*COMBINATION).distinct()
    flags = unseen_flags(combos, baseline, COMBINATION)
    return events.join(flags, COMBINATION).withColumn("weight", F.lit(1).cast("long")).select(
        *EVENT_COLUMNS, "weight", *FLAGS
    )


def new_baseline_keys(baseline: DataFrame, events: DataFrame, as_of=None) -> DataFrame:
    """Keys of the events that the baseline does not hold yet."""
    fresh = known_keys(events)
    added = fresh.join(baseline, _same_key(fresh, baseline), "left_anti")
    return added.withColumn("as_of", F.lit(as_of).cast("date"))


def update_baseline(baseline: DataFrame, events: DataFrame, as_of=None) -> DataFrame:
    """Baseline with the events' new keys added; known keys keep their date."""
    return baseline.unionByName(new_baseline_keys(baseline, events, as_of))


# ---------------------------------------------------------------- policy

def rule_table(rules: DataFrame) -> DataFrame:
    """Rules per user as one array in rule order (``rule_ord``, else rule_id).

    The length of an array is the number of rules written for one user.
    """
    require_columns(rules, RULE_COLUMNS, "policy rules")
    types = dict(rules.dtypes)
    order = F.col("rule_ord").cast("string") if "rule_ord" in rules.columns else F.col("rule_id").cast("string")
    position = F.col("rule_ord").cast("long") if "rule_ord" in rules.columns else F.lit(0).cast("long")
    entry = F.struct(
        position.alias("position"), order.alias("order"),
        F.col("rule_id").cast("string").alias("rule_id"),
        *[F.coalesce(F.col(f"any_{f}").cast("boolean"), F.lit(False)).alias(f"any_{f}") for f in POLICY_FIELDS],
        *[
            parse_allowlist(c, types[c] == "string").alias(f"allowed_{f}")
            for f, c in zip(POLICY_FIELDS, RULE_COLUMNS[5:])
        ],
    )
    return rules.groupBy(F.col("user").cast("string").alias("user")).agg(
        F.array_sort(F.collect_list(entry)).alias("rules")
    )


def field_match(value: Column, any_flag: Column, allowed: Column) -> Column:
    """ANY, UNKNOWN (no list), ALLOW (listed) or VIOLATION."""
    return (
        F.when(any_flag, "ANY").when(allowed.isNull(), "UNKNOWN")
        .when(F.coalesce(F.array_contains(allowed, value), F.lit(False)), "ALLOW")
        .otherwise("VIOLATION")
    )


def evaluate_rules(rules: Column) -> Column:
    """Best rule for the row: most fields met, then the earliest.

    A rule that meets all three fields is necessarily the best one.
    """
    def states(rule: Column) -> Column:
        return F.struct(rule["rule_id"].alias("rule_id"), *[
            field_match(F.col(c), rule[f"any_{f}"], rule[f"allowed_{f}"]).alias(f)
            for f, c in POLICY_FIELDS.items()
        ])

    def outcome(state: Column, i: Column) -> Column:
        met, broken = F.lit(0), F.lit(False)
        for f in POLICY_FIELDS:
            met = met + state[f].isin("ANY", "ALLOW").cast("int")
            broken = broken | (state[f] == "VIOLATION")
        return F.struct(
            met.alias("met"), (-i).alias("rank"), state["rule_id"].alias("rule_id"),
            broken.alias("broken"), *[state[f].alias(f) for f in POLICY_FIELDS],
        )

    return F.transform(F.transform(rules, states), outcome)


def policy_features(events: DataFrame, rules: DataFrame | None, salts: int = RULE_SALTS) -> DataFrame:
    """Policy status, risks, field flags and rule ids of functional users' rows.

    Other users get status NA and zeros. Users without rules are UNKNOWN. A row
    is settled locally once its user's rules are attached. Rules are few, so
    each user's are repeated ``salts`` times and a busy user's rows meet them in
    as many tasks.
    """
    functional = F.col("user_type") == "functional"
    if rules is None:
        attached = events.withColumn("outcomes", F.lit(None).cast(
            "array<struct<met:int,rank:int,rule_id:string,broken:boolean,remote:string,device:string,command:string>>"
        ))
    else:
        table = rule_table(rules).select(
            F.col("user").alias("rule_user"), "rules",
            F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("rule_salt"),
        )
        # The event's own identity is part of the salt: a user who repeats one
        # combination is spread as well.
        own = [c for c in ("remote_address", "device_ip_address", "cmd_group", "uid", "_time") if c in events.columns]
        salt = F.pmod(F.xxhash64(*own), F.lit(salts)).cast("int")
        # The condition on the type belongs to the join, so other users' rows
        # do not look for rules.
        attached = events.withColumn("salt", salt).join(
            table, functional & (F.col("user") == F.col("rule_user")) & (F.col("salt") == F.col("rule_salt")), "left"
        ).withColumn("outcomes", evaluate_rules(F.col("rules"))).drop("rules", "rule_user", "rule_salt", "salt")
    best = F.array_max("outcomes")
    allowed = F.col("best.met") == 3
    open_rule = F.exists("outcomes", lambda o: ~o["broken"])
    status = (
        F.when(~functional, "NA").when(F.col("best").isNull(), "UNKNOWN").when(allowed, "ALLOW")
        .when(open_rule, "UNKNOWN").otherwise("VIOLATION")
    )

    def field_flag(field: str, wanted: str) -> Column:
        state = F.coalesce(F.col(f"best.{field}"), F.lit("UNKNOWN"))
        return (functional & (state == wanted)).cast("int")

    flags = {f"{f}_violation": field_flag(f, "VIOLATION") for f in POLICY_FIELDS}
    flags |= {f"{f}_unknown": field_flag(f, "UNKNOWN") for f in POLICY_FIELDS}
    risk = sum(w * F.col(f"{f}_violation") for f, w in VIOLATION_WEIGHTS.items())
    gap = sum(w * F.col(f"{f}_unknown") for f, w in UNKNOWN_WEIGHTS.items())
    return (
        attached.withColumn("best", best)
        .withColumns({"policy_status": status, **flags})
        .withColumns({
            "policy_risk": risk.cast("double"), "control_gap_risk": gap.cast("double"),
            "best_rule_id": F.when(functional, F.col("best.rule_id")),
            "matched_rule_id": F.when(functional & allowed, F.col("best.rule_id")),
        })
        .drop("best", "outcomes")
    )


# ---------------------------------------------------------------- risk

def event_risk(events: DataFrame, ceiling: int = POLICY_RISK_CEILING, cap: bool = True) -> DataFrame:
    """Weighted novelty plus any policy risks, and its share of ``ceiling``.

    Whole numbers throughout, so later sums do not depend on their order.
    """
    total = sum(w * F.col(flag) for flag, w in NOVELTY_WEIGHTS.items()).cast("double")
    for part in ("policy_risk", "control_gap_risk"):
        if part in events.columns:
            total = total + F.col(part)
    share = F.col("event_risk") / F.lit(float(ceiling))
    return events.withColumn("event_risk", total).withColumns({
        "event_risk_norm": cap_at_one(share) if cap else share, "risk_ceiling": F.lit(float(ceiling)),
    })


def event_risk_basic(events: DataFrame) -> DataFrame:
    """Novelty risk alone, as a share of its own maximum."""
    return event_risk(events, BASIC_RISK_CEILING, cap=False)


# ---------------------------------------------------------------- user-days

def user_day_features(events: DataFrame, ceiling: int | None = None, counts: bool = False) -> DataFrame:
    """Rates, risks and volumes per user and day, in one aggregation.

    Policy columns are used when present; ``counts`` adds the flag totals. Risks
    are shares of the ceiling that the events carry, or of the given one.
    """
    most = F.col("risk_ceiling") if ceiling is None and "risk_ceiling" in events.columns else F.lit(float(ceiling or POLICY_RISK_CEILING))
    weight = F.col("weight") if "weight" in events.columns else F.lit(1).cast("long")
    has_policy = all(
        f"{f}_{s}" in events.columns for f in POLICY_FIELDS for s in ("violation", "unknown")
    ) and {"policy_risk", "control_gap_risk"} <= set(events.columns)
    n = F.col("total_events")

    sums = {flag: F.sum(F.col(flag) * weight) for flag in FLAGS}
    # Summing capped whole risks and dividing once keeps the mean exact.
    sums["risk"] = F.sum(F.least(F.col("event_risk"), most) * weight)
    if has_policy:
        for f in POLICY_FIELDS:
            for s in ("violation", "unknown"):
                sums[f"{f}_{s}"] = F.sum(F.col(f"{f}_{s}") * weight)
        sums["policy_risk"] = F.sum(F.col("policy_risk") * weight)
        sums["control_gap_risk"] = F.sum(F.col("control_gap_risk") * weight)

    totals = events.groupBy("user", "event_date").agg(
        F.min_by("user_type", F.struct("_time", "uid")).alias("user_type"),
        F.sum(weight).alias("total_events"),
        F.max("event_risk_norm").alias("max_risk_norm"), F.max(most).alias("most_risk"),
        *[expr.alias(f"sum_{name}") for name, expr in sums.items()],
    )

    def rate(name: str) -> Column:
        return F.col(f"sum_{name}") / n

    columns = ["user", "event_date", "user_type", "total_events", F.log1p(n).alias("log_events")]
    columns += [rate(flag).alias(f"{flag}_rate") for flag in FLAGS]
    columns += [(rate("risk") / F.col("most_risk")).alias("avg_risk_norm"), "max_risk_norm"]
    if counts:
        columns += [F.col(f"sum_{flag}").alias(f"{flag}_count") for flag in FLAGS]
    if has_policy:
        columns += [rate(f"{f}_{s}").alias(f"{f}_{s}_rate") for s in ("violation", "unknown") for f in POLICY_FIELDS]
        columns += [rate("policy_risk").alias("avg_policy_risk"), rate("control_gap_risk").alias("avg_control_gap_risk")]
        for s, name in (("violation", "policy_violation_rate"), ("unknown", "unknown_policy_ratio")):
            columns.append(sum(rate(f"{f}_{s}") for f in POLICY_FIELDS).alias(name))
    return totals.select(*columns)


def merge_graph_features(user_days: DataFrame, graph: DataFrame) -> DataFrame:
    """Attach graph measures by user and day, 0 where there are none.

    A repeated (user, day) in ``graph`` would multiply rows, so it fails the job.
    """
    require_columns(graph, GRAPH_FEATURE_COLUMNS, "graph features")
    values = GRAPH_FEATURE_COLUMNS[2:]
    unique = graph.groupBy("user", F.to_date("event_date").alias("event_date")).agg(
        *[F.max(v).alias(v) for v in values], F.count("*").alias("copies")
    )
    repeated = F.raise_error(F.concat(F.lit("graph features repeat user "), F.col("user")))
    checked = unique.select("user", "event_date", *[
        F.when(F.col("copies") > 1, repeated.cast("double")).otherwise(F.col(v)).alias(v) for v in values
    ])
    joined = user_days.join(checked, ["user", "event_date"], "left")
    zero = F.lit(0.0)
    return joined.withColumns({
        "entropy_norm": F.coalesce("entropy", zero),
        "degree_norm": F.coalesce("degree", zero) / F.greatest("total_events", F.lit(1)),
        "clustering_coeff": F.coalesce("clustering_coefficient", zero),
    })


def warmup(user_days: DataFrame, cfg: AccessConfig = AccessConfig()) -> DataFrame:
    """Days since the user was first seen, and whether the day is still warm-up."""
    first = F.min("event_date").over(Window.partitionBy("user"))
    required = F.when(F.col("user_type") == "functional", cfg.functional.warmup_days).otherwise(cfg.human.warmup_days)
    return user_days.withColumns({
        "days_since_first_seen": F.date_diff("event_date", first), "warmup_days_required": required,
    }).withColumn("is_warmup", F.col("days_since_first_seen") < F.col("warmup_days_required"))


def training_set(user_days: DataFrame, role: str, limits: RoleLimits) -> DataFrame:
    """The user-days of a role after warm-up and within its limits."""
    chosen = (F.col("user_type") == role) & ~F.col("is_warmup") & (F.col("total_events") >= limits.min_events)
    for column, limit in limits.below:
        chosen = chosen & (F.col(column) < limit)
    for column, limit in limits.at_most:
        if column in user_days.columns:
            chosen = chosen & (F.col(column) <= limit)
    return user_days.where(chosen)


def human_training_set(user_days: DataFrame, cfg: AccessConfig = AccessConfig()) -> DataFrame:
    return training_set(user_days, "human", cfg.human)


def functional_training_set(user_days: DataFrame, cfg: AccessConfig = AccessConfig()) -> DataFrame:
    return training_set(user_days, "functional", cfg.functional)


# ---------------------------------------------------------------- reasons

# Columns named as reasons, in order, with the value each must exceed.
REASONS_WITH_POLICY = [
    ("new_remote_rate", 0.0),
    ("new_device_rate", 0.0),
    ("new_remote_cmd_pair_rate", 0.0),
    ("new_device_cmd_pair_rate", 0.0),
    ("policy_violation_rate", 0.0),
    ("unknown_policy_ratio", 0.0),
    ("max_risk_norm", 0.5),
    ("entropy_norm", 0.8),
    ("degree_norm", 0.5),
]
REASONS_BASIC = [
    ("new_remote_rate", 0.0),
    ("new_device_rate", 0.0),
    ("new_remote_cmd_pair_rate", 0.0),
    ("max_risk_norm", 0.5),
    ("entropy_norm", 0.8),
    ("degree_norm", 0.5),
    ("policy_violation_rate", 0.0),
]
NO_SINGLE_REASON = "isolated_by_feature_combination"


def explain(scored: DataFrame, spec: list[tuple[str, float]] = REASONS_WITH_POLICY) -> DataFrame:
    """Add the readable reasons of each row; a column the table lacks gives none."""
    found = F.array_compact(F.array(*[reason(c, over) for c, over in spec if c in scored.columns]))
    return scored.withColumn(
        "reasons", F.when(F.size(found) == 0, F.array(F.lit(NO_SINGLE_REASON))).otherwise(found)
    )


def direct_policy_alert(scored: DataFrame) -> DataFrame:
    """Functional user-days with any violation; null for other users."""
    violated = F.col("policy_violation_rate") > 0 if "policy_violation_rate" in scored.columns else F.lit(False)
    return scored.withColumn(
        "direct_policy_alert", F.when(F.col("user_type") == "functional", violated)
    )
