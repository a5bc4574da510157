"""Sharding by sampled splitters (DataFrame functions only).

Rows are ordered by the key (text_key, doc_id), so copies of a text are
neighbours. A sample of keys is drawn in proportion to size (half of the
weight is the row itself, so that no range gets too many small rows), its
quantiles split the keys into ranges, and every row finds its range by binary
search. Ranges that are overfull are split again by a sample of their own, in
parallel and as often as it takes, so a range has at most ``RANGE_ROWS`` rows:
by text_key first, and a range of one text by doc_id and row. Sums over
ranges, which are exact, then give each row its place in the order of all rows
and the bytes before it, and a shard is an equal share of those bytes.

Copies of a text stay in one shard unless they are more than a 100th of a
shard (``WHOLE``); then the border may run between them. Only rows of about
100 bytes are shuffled, never texts.

Cases: a null text counts as empty (size 1); null ids come first; rows equal
in text and id are neighbours; an empty table gives no rows, and a table
with fewer rows than shards leaves shards empty. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import materialise

from .shared import crc32_table_sql, crc32_sql, free_name

SHARDS = 16
LAW = "bytes"
#: Most rows of a range, most ranges that one is split into, and sampled keys per range.
RANGE_ROWS = 1024
FAN_OUT = 1024
SAMPLED = 16
#: Copies with fewer bytes than this part of a shard are never parted.
WHOLE = 100
#: A text's key: the first hexadecimal digits of its MD5.
KEY_DIGITS = 16

_KEY = ("text_key", "doc_id", "row")


def text_key(text: Column | str) -> Column:
    return F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, KEY_DIGITS)


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, text_key, a number of the row, and the range of all rows, stored."""
    text = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        text_key(text).alias("text_key"), F.monotonically_increasing_id().alias("row"),
        F.lit(0).cast("long").alias("top"), F.lit(0).cast("long").alias("range"))
    return materialise(rows, "shard-rows")


def _lowest(key: Column) -> Column:
    """The least key of a text."""
    return F.struct(key.alias("text_key"), F.lit(None).alias("doc_id"), F.lit(-1).cast("long").alias("row"))


def splitters(rows: DataFrame, stats: DataFrame, seed: int) -> DataFrame:
    """range, splits: sorted keys at quantiles of a sample of each range of ``stats`` (range, n, bytes, low, high)."""
    kind = rows.schema["doc_id"].dataType
    fan_out = F.least(F.lit(FAN_OUT), F.ceil(F.col("n") * 4 / RANGE_ROWS))
    chance = SAMPLED * F.col("fan_out") * (F.col("size") / F.col("bytes") + 1 / F.col("n")) / 2
    draw = F.pmod(F.xxhash64(*_KEY, F.lit(seed)), F.lit(2**52)) / F.lit(float(2**52))
    key = F.when(F.col("low") < F.col("high"), F.struct(
        "text_key", F.lit(None).cast(kind).alias("doc_id"), F.lit(-1).cast("long").alias("row"))).otherwise(F.struct(*_KEY))
    sample = rows.join(stats.withColumn("fan_out", fan_out), "range").withColumn("hits", F.floor(chance + draw)).where("hits > 0")
    sample = sample.groupBy("range", key.alias("key")).agg(
        F.sum("hits").alias("hits"), F.first("fan_out").alias("fan_out"), F.first(F.col("low") < F.col("high")).alias("texts"))
    until = Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = lambda c: F.floor(c * F.col("fan_out") / F.col("all"))
    sample = sample.withColumns({"until": F.sum("hits").over(until), "all": F.sum("hits").over(Window.partitionBy("range"))})
    found = sample.withColumn("steps", step(F.col("until")) - step(F.col("until") - F.col("hits"))).where("steps > 0")
    # A text that fills a range of its own also ends one: what follows it is apart.
    after = F.struct(F.concat("key.text_key", F.lit("0")).alias("text_key"), F.col("key.doc_id"), F.col("key.row"))
    ends = F.when(F.col("texts") & (F.col("steps") > 1), F.array("key", after)).otherwise(F.array("key"))
    return found.groupBy("range").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(ends)))).alias("splits"))


def search(splits: Column, key: Column) -> Column:
    """How many of the sorted ``splits`` are at most ``key``, by binary search."""
    steps = F.array(*[F.lit(2**k) for k in range((2 * FAN_OUT).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(splits, at + step - 1) <= key, at + step).otherwise(at))


def _stats(rows: DataFrame, name: str) -> DataFrame:
    return materialise(rows.groupBy("top", "range").agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("text_key").alias("low"), F.max("text_key").alias("high"),
        F.min(F.struct(*_KEY)).alias("first")), name)


def ranged(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with ``top`` and ``range``, and the stored ranges (top, range, n, bytes, low, high, first) of at most RANGE_ROWS rows."""
    waiting, stats = rows, _stats(rows, "shard-all")
    done, ranges, level = [], [], 0
    while True:
        # At first there is one range, so one row is looked up; later the tables' sizes decide.
        small = F.broadcast if level == 0 else lambda table: table
        splits = materialise(splitters(waiting, small(stats), level), "shard-splitters")
        dealt = waiting.join(small(splits), "range", "left").withColumn("part", search(F.col("splits"), F.struct(*_KEY)).cast("long"))
        dealt = dealt.withColumns({
            "range": F.col("range") * (4 * FAN_OUT) + F.col("part") + 1, "top": F.col("part") if level == 0 else F.col("top")})
        dealt = materialise(dealt.drop("part", "splits"), "shard-dealt")
        stats = _stats(dealt, "shard-ranges")
        over = stats.where(F.col("n") > RANGE_ROWS)
        done.append(dealt.join(over.select("range"), "range", "left_anti"))
        ranges.append(stats.where(F.col("n") <= RANGE_ROWS))
        if over.isEmpty():
            break
        waiting, stats, level = dealt.join(over.select("range"), "range", "left_semi"), over, level + 1
    for table in (done, ranges):
        while len(table) > 1:
            table[:2] = [table[0].unionByName(table[1])]
    return done[0], ranges[0]


def _starts(ranges: DataFrame) -> DataFrame:
    """range, rows and bytes before it; for ranges of one text also the start and bytes of all its copies."""
    def before(column: str, window) -> Column:
        return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")

    tops = ranges.groupBy("top").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    by_top = Window.orderBy("top")  # at most 2 * FAN_OUT + 1 rows
    tops = tops.select("top", before("n", by_top).alias("top_rows"), before("bytes", by_top).alias("top_bytes"))
    inside = Window.partitionBy("top").orderBy("first")
    starts = ranges.select("top", "range", "low", "high", "bytes", before("n", inside).alias("rows"), before("bytes", inside).alias("start"))
    starts = starts.join(tops, "top").select(
        "range", "low", "high", "bytes", (F.col("rows") + F.col("top_rows")).alias("rows"), (F.col("start") + F.col("top_bytes")).alias("start"))
    starts = materialise(starts, "shard-starts")
    copies = starts.where("low = high").groupBy("low").agg(F.min("start").alias("copies_start"), F.sum("bytes").alias("copies_bytes"))
    alone = starts.where("low = high").join(copies, "low").select("range", "rows", "start", "copies_start", "copies_bytes")
    return alone.unionByName(starts.where("low < high").select("range", "rows", "start"), allowMissingColumns=True)


def sharded(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, text_key, shard and slot (the place in the shard, in the order of keys) of every row."""
    rows, ranges = ranged(keyed(docs, doc_id, text))
    total = F.lit(ranges.agg(F.sum("bytes")).first()[0] or 1)
    until = Window.partitionBy("range").orderBy(*_KEY)
    copies = Window.partitionBy("range", "text_key")
    placed = rows.withColumns({
        "nth": F.row_number().over(until), "before": F.sum("size").over(until.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")})
    placed = placed.withColumns({"all_bytes": F.sum("size").over(copies), "all_before": F.min("before").over(copies)})
    placed = placed.join(_starts(ranges), "range")
    all_bytes = F.coalesce("copies_bytes", "all_bytes")
    kept_whole = all_bytes * (WHOLE * shards) <= total
    begin = F.when(kept_whole, F.coalesce("copies_start", F.col("start") + F.col("all_before"))).otherwise(F.col("start") + F.col("before"))
    length = F.when(kept_whole, all_bytes).otherwise(F.col("size"))
    # The middle decides; it is below the total, so the share is below the number of shards.
    shard = F.floor((2 * begin + length) * shards / (2 * total)).cast("int")
    placed = placed.select(
        "doc_id", "size", "text_crc32", "text_key", F.least(shard, F.lit(shards - 1)).alias("shard"), (F.col("rows") + F.col("nth") - 1).alias("rank"))
    placed = materialise(placed, "shard-placed")
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "text_key", "shard", (F.col("rank") - F.col("first")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", name: str = "shard") -> DataFrame:
    """The rows of ``docs`` with their shard as a last column ``name``, with underscores added if it is taken.

    The first keys of the shards, at most ``shards`` rows, decide, so texts
    are not shuffled. Of rows equal in text and id on both sides of a border
    all go to its upper side.
    """
    key = F.struct("text_key", "doc_id")
    cuts = sharded(docs, shards, doc_id, text).groupBy("shard").agg(F.min(key).alias("cut")).collect()
    kind = docs.schema[doc_id].dataType
    own = F.struct(text_key(docs[text]).alias("text_key"), docs[doc_id].alias("doc_id"))
    shard = F.lit(0)
    for row in sorted(cuts, key=lambda r: r["shard"]):
        cut = F.struct(F.lit(row["cut"]["text_key"]).alias("text_key"), F.lit(row["cut"]["doc_id"]).cast(kind).alias("doc_id"))
        shard = F.when(own >= cut, F.lit(row["shard"])).otherwise(shard)
    return docs.select("*", shard.cast("int").alias(free_name(docs, name)))


def op11_sharding(spark, sf_dir: str) -> DataFrame:
    found = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP11_SQL = f"""
WITH RECURSIVE {crc32_table_sql()},
rows AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32,
    substr(md5(coalesce(text, '')), 1, {KEY_DIGITS}) AS text_key
  FROM documents, crc_table),
placed AS (SELECT *,
    sum(size) OVER (ORDER BY text_key, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before,
    sum(size) OVER (ORDER BY text_key) - sum(size) OVER (PARTITION BY text_key) AS all_before,
    sum(size) OVER (PARTITION BY text_key) AS all_bytes, sum(size) OVER () AS total
  FROM rows),
dealt AS (SELECT *, CAST(floor(CASE WHEN all_bytes * {WHOLE * SHARDS} <= total THEN (2 * all_before + all_bytes) * {SHARDS} / (2 * total)
    ELSE (2 * before + size) * {SHARDS} / (2 * total) END) AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, text_crc32, '{LAW}' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY text_key, doc_id NULLS FIRST) - 1 AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM dealt
"""
