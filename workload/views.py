"""The test tables seen as call logs, access logs, command logs and accounts.

Every view is a projection of whole tables, once as a DataFrame and once as
SQL for the checker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMANDS = {
    "click": "show running-config",
    "error": "reload",
    "purchase": "copy run start",
    "signup": "username add x",
    "view": "ping 8.8.8.8",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def _user():
    return F.concat(F.when(F.col("user_id") % 5 == 0, "svc_").otherwise("u"), F.col("user_id").cast("string"))


def _role():
    return F.when(F.col("user_id") % 5 == 0, "functional").otherwise("human")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call log; each date is one source file."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"),
        F.concat(F.lit("ACCT"), _k().cast("string")).alias("account"),
        F.when(F.col("event_type") == "error", "Manual call").otherwise("other call").alias("id_chat"),
        F.col("ts").alias("dttm"),
        F.to_date("ts").cast("string").alias("source_file"),
    )


STRAGGLERS = "2024-01-14"


def call_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call log in four files per date; some calls of one date come in a file of the date after."""
    date = F.to_date("ts")
    late = (date == STRAGGLERS) & (F.col("event_id") % 8 == 0)
    named = F.concat(F.when(late, F.date_add(date, 1)).otherwise(date).cast("string"), F.lit("-"), (F.col("event_id") % 4).cast("string"))
    calls_of = table(spark, sf_dir, "events").withColumn("part", named)
    return calls_of.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"),
        F.when(F.col("event_type") == "error", "Manual call").otherwise("other call").alias("id_chat"),
        F.col("ts").alias("dttm"), F.col("part").alias("source_file"),
    )


def time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times written in five ways, one of them unreadable."""
    forms = ["yyyy-MM-dd HH:mm:ss", "M/d/yyyy H:mm", "yyyyMMddHHmmss", "MM/dd/yyyy hh:mm:ss a"]
    text = F.lit("soon")
    for k, form in enumerate(forms):
        text = F.when(F.col("event_id") % 5 == k, F.date_format("ts", form)).otherwise(text)
    return table(spark, sf_dir, "events").select("event_id", text.alias("seen"))


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw access events."""
    cmd = F.lit(None).cast("string")
    for event_type, command in COMMANDS.items():
        cmd = F.when(F.col("event_type") == event_type, command).otherwise(cmd)
    return table(spark, sf_dir, "events").select(
        _user().alias("user"), F.col("ts").alias("_time"), F.col("event_id").cast("string").alias("uid"),
        F.concat(F.lit("10.0."), (_k() % 7).cast("string")).alias("remote_address"),
        F.concat(F.lit("dev"), (_k() % 11).cast("string")).alias("device_ip_address"),
        cmd.alias("cmd"), _role().alias("user_type"),
    )


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two policy rules for two thirds of the functional users."""
    n = F.col("user_id")
    ruled = table(spark, sf_dir, "events").where((n % 5 == 0) & (n % 15 != 0)).select(n, _user().alias("user")).distinct()
    none = F.lit(None).cast("array<string>")
    yes, no = F.lit(True), F.lit(False)
    commands = F.array(*[F.lit(c) for c in ("SHOW_CONFIG", "COPY", "PING")])
    remotes = F.array(F.concat(F.lit("10.0."), (n % 7).cast("string")))
    devices = F.when(n % 10 != 0, F.array(*[F.lit(f"dev{i}") for i in range(6)]))

    def rule(i, any_remote, any_device, any_command, remote, device, command):
        return F.struct(
            F.lit(f"r{i}").alias("rule_id"), F.lit(i).alias("rule_ord"), any_remote.alias("any_remote"),
            any_device.alias("any_device"), any_command.alias("any_command"),
            remote.alias("allowed_remote_ips"), device.alias("allowed_device_ips"),
            command.alias("allowed_commands"),
        )

    return ruled.select("user", F.inline(F.array(
        rule(1, yes, yes, no, none, none, commands), rule(2, no, no, yes, remotes, devices, none)
    )))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Command log with 100 commands and two roles."""
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("timestamp"), _user().alias("user"),
        F.concat("event_type", F.lit(" "), (_k() % 20).cast("string")).alias("command"),
        _role().alias("account_type"),
    )


def similarity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input of the user graph."""
    return table(spark, sf_dir, "events").select(
        _user().alias("user"), _role().alias("user_type"), F.col("ts").alias("_time"),
        F.to_date("ts").alias("event_date"),
        F.concat(F.lit("n"), (_k() % 7).cast("string")).alias("remote_network"),
        F.concat(F.lit("d"), (_k() % 11).cast("string")).alias("device_ip_address"),
        F.concat("event_type", F.lit(" op"), (_k() % 3).cast("string")).alias("cmd_keywords"),
    )


def ordered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names ordered by each customer, as commands with a time."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("o_custkey").alias("user"), F.col("p_name").alias("command"), "o_orderdate")
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account names of eight shapes made from customers."""
    n = F.col("c_custkey")
    num = n.cast("string")

    def led(prefix):
        return F.concat(F.lit(prefix), num)

    shape = n % 8
    name = (
        F.when(shape == 0, led("jd")).when(shape == 1, led("svc-")).when(shape == 2, led("a."))
        .when(shape == 3, led("Vjo")).when(shape == 4, led("JoD")).when(shape == 5, led("ABC"))
        .when(shape == 6, F.concat(F.lit(" z "), F.lit(""))).otherwise(F.concat(led("longname"), F.lit("x")))
    )
    return table(spark, sf_dir, "customer").select(name.alias("user"), "c_custkey", "c_acctbal")


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory ids: account names of customers with a high balance, in upper case."""
    return accounts(spark, sf_dir).where(F.col("c_acctbal") > 5000).select(F.upper("user").alias("directory_id"))


# ---------------------------------------------------------------- the same in SQL

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
USER = "CASE WHEN user_id % 5 = 0 THEN 'svc_' ELSE 'u' END || user_id"
ROLE = "CASE WHEN user_id % 5 = 0 THEN 'functional' ELSE 'human' END"
COMMAND_CASE = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{c}'" for e, c in COMMANDS.items()) + " END"

SQL = {
    "v_calls": f"""SELECT 'u' || user_id AS "user", 'ACCT' || {K} AS account,
        CASE WHEN event_type = 'error' THEN 'Manual call' ELSE 'other call' END AS id_chat,
        ts AS dttm, CAST(ts AS DATE) AS date FROM events""",
    "v_parts": f"""SELECT *, max(CAST(ts AS DATE)) OVER (PARTITION BY part) AS day FROM (
        SELECT 'u' || user_id AS "user", ts, event_type,
          CASE WHEN CAST(ts AS DATE) = DATE '{STRAGGLERS}' AND event_id % 8 = 0 THEN CAST(ts AS DATE) + 1 ELSE CAST(ts AS DATE) END
            || '-' || event_id % 4 AS part FROM events)""",
    "v_access": f"""SELECT {USER} AS "user", user_id, ts AS _time, CAST(event_id AS VARCHAR) AS uid,
        '10.0.' || ({K} % 7) AS remote_address, 'dev' || ({K} % 11) AS device_ip_address,
        {COMMAND_CASE} AS cmd, {ROLE} AS user_type FROM events""",
    "v_rules": f"""SELECT DISTINCT {USER} AS "user", r.rule_id, r.rule_ord, r.any_remote, r.any_device, r.any_command,
        r.allowed_remote, r.allowed_device, r.allowed_command
        FROM events, LATERAL (
          SELECT 'r1' AS rule_id, 1 AS rule_ord, true AS any_remote, true AS any_device, false AS any_command,
            CAST(NULL AS VARCHAR[]) AS allowed_remote, CAST(NULL AS VARCHAR[]) AS allowed_device,
            ['SHOW_CONFIG', 'COPY', 'PING'] AS allowed_command
          UNION ALL SELECT 'r2', 2, false, false, true, ['10.0.' || (user_id % 7)],
            CASE WHEN user_id % 10 <> 0 THEN ['dev0', 'dev1', 'dev2', 'dev3', 'dev4', 'dev5'] END,
            CAST(NULL AS VARCHAR[])
        ) r WHERE user_id % 5 = 0 AND user_id % 15 <> 0""",
    "v_cmds": f"""SELECT ts AS timestamp, {USER} AS "user", event_type || ' ' || ({K} % 20) AS command,
        {ROLE} AS account_type, (isodow(ts) - 1) * 24 + hour(ts) AS hour_of_week FROM events""",
    "v_sim": f"""SELECT {USER} AS "user", {ROLE} AS user_type, ts AS _time, CAST(ts AS DATE) AS event_date,
        'n' || ({K} % 7) AS remote_network, 'd' || ({K} % 11) AS device_ip_address,
        event_type || ' op' || ({K} % 3) AS cmd_keywords FROM events""",
    "v_orders_cmd": """SELECT o_custkey AS "user", p_name AS command, o_orderdate
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "v_accounts": """SELECT CASE c_custkey % 8 WHEN 0 THEN 'jd' || c_custkey WHEN 1 THEN 'svc-' || c_custkey
        WHEN 2 THEN 'a.' || c_custkey WHEN 3 THEN 'Vjo' || c_custkey WHEN 4 THEN 'JoD' || c_custkey
        WHEN 5 THEN 'ABC' || c_custkey WHEN 6 THEN ' z ' ELSE 'longname' || c_custkey || 'x' END AS "user",
        c_custkey, c_acctbal FROM customer""",
}
