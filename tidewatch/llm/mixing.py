"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Each source has a target number of words. A document gets the whole part of
target / source size as certain copies; the rest p is its inclusion
probability for one more. Documents are ranked by their random odds divided by
their inclusion odds, (u / (1 - u)) / (p / (1 - p)), and the ranking is cut
where the sampled words come nearest to what is missing, so a source's words
are fixed up to half a document.

No source is ordered as a whole: ranks fall into 1,024 cells, the words of
cells are added, and only the cell that holds the cut is looked at again, by
its own 1,024 cells, and then row by row. The decision of a row needs only its
own values and its source's plan, so documents are never shuffled.

Cases: null texts and texts without words have size 0 and take 0 words; a null
source is a source; rows equal in id and text rank alike and are taken
together; an empty table gives no rows. Ids may be null or repeat. Other
columns are not looked at, whatever their names; the mixed documents keep them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import materialise

from .shared import word_count

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
CELLS = 1024
SEED = "mix"


def draw(key: Column) -> Column:
    """A number between 0 and 1 from the first 52 bits of the key's MD5 text."""
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def sized(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: str = SEED) -> DataFrame:
    """Add ``mix_size`` and ``mix_draw``."""
    key = F.md5(F.concat(
        F.lit(seed), F.lit("|"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|"),
        F.coalesce(F.col(text), F.lit(""))))
    return docs.withColumns({"mix_size": word_count(text), "mix_draw": draw(key)})


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Targets of ``sizes`` (source, source_size): one row per source.

    Sources by code point, null last, weigh ``weights`` in turn and share all
    words. A target stops at ``most`` times its source's size and the excess
    is shared again by weight: the level per weight unit is that of the first
    source, by cap per weight, which stays under its cap once those before it
    are held at theirs.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sizes.select(
        "source", "source_size",
        F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("long").alias("weight"))
    cap = F.col("source_size") * most
    by_cap = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))).cast("double")
        / F.sum("weight").over(after)
    )
    found = ranked.withColumns({"level": level, "order": F.row_number().over(by_cap)}).withColumn(
        "fits", F.when(F.col("level") <= cap / F.col("weight"), F.struct("order", "level")))
    return found.withColumn("shared", F.coalesce(F.min("fits").over(everything)["level"], F.lit(0.0))).select(
        "source", "source_size", "weight", F.least(F.col("shared") * F.col("weight"), cap.cast("double")).alias("target"))


def _rank(p: Column) -> Column:
    u = F.col("mix_draw")
    return (u / (1 - u)) / (p / (1 - p))


def _cell(rank: Column) -> Column:
    """Cells keep the order of ranks and cover them evenly around rank 1, where the cut lies."""
    return F.floor(rank / (1 + rank) * (CELLS * CELLS)).cast("long")


def _with_source(rows: DataFrame, plan: DataFrame) -> DataFrame:
    other = plan.withColumnRenamed("source", "plan_source")
    return rows.join(other, F.col("source").eqNullSafe(F.col("plan_source")), "left").drop("plan_source")


def _cut(rows: DataFrame, cell: Column) -> DataFrame:
    """Per source the cell that holds the cut, and the words before it."""
    words = rows.groupBy("source", cell.alias("cell")).agg(
        F.sum("mix_size").alias("words"), F.first("missing").alias("missing"), F.first("passed").alias("passed"))
    until = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        words.withColumn("end", F.sum("words").over(until) + F.col("passed"))
        .where((F.col("end") - F.col("words") <= F.col("missing")) & (F.col("missing") < F.col("end")))
        .select("source", "cell", (F.col("end") - F.col("words")).alias("passed"))
    )


def plan_mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The plan of each source: size, target, certain copies, and where its ranking is cut.

    ``rows``: stored rows of source, mix_size, mix_draw.
    """
    sizes = materialise(rows.groupBy("source").agg(F.sum("mix_size").alias("source_size")), "mix-sizes")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = targets(sizes, weights, most).withColumn("whole", F.floor(ratio)).withColumns({
        "p": ratio - F.col("whole"), "missing": F.col("target") - F.col("whole") * F.col("source_size")})
    plan = materialise(plan, "mix-targets")

    ranked = (
        _with_source(rows, plan.select("source", "p", "missing")).where("p > 0")
        .withColumn("rank", _rank(F.col("p"))).withColumn("fine", _cell(F.col("rank")))
    )
    coarse = materialise(_cut(ranked.withColumn("passed", F.lit(0).cast("long")), F.floor(F.col("fine") / CELLS)), "mix-coarse")
    inside = _with_source(ranked, coarse).where(F.floor(F.col("fine") / CELLS) == F.col("cell")).drop("cell")
    fine = materialise(_cut(inside, F.col("fine")), "mix-fine")
    last = _with_source(ranked, fine).where(F.col("fine") == F.col("cell"))
    alike = last.groupBy("source", "rank").agg(
        F.sum("mix_size").alias("words"), F.first("missing").alias("missing"), F.first("passed").alias("passed"))
    until = Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    near = alike.withColumn("start", F.coalesce(F.sum("words").over(until), F.lit(0)) + F.col("passed"))
    edge = near.groupBy("source").agg(
        F.max(F.when(F.col("start") + F.col("words") / 2 <= F.col("missing"), F.col("rank"))).alias("last_rank"))
    joined = _with_source(plan, fine.select("source", F.col("cell").alias("cut_cell")))
    return materialise(_with_source(joined, edge), "mix-plan")


def decide(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Add source_size, target and ``copies`` to rows with mix_size and mix_draw."""
    found = _with_source(rows, plan.select("source", "source_size", "target", "whole", "p", "cut_cell", "last_rank"))
    rank = _rank(F.col("p"))
    one = (
        F.when(F.col("p") <= 0, F.lit(0))
        .when(F.col("cut_cell").isNull() | (_cell(rank) < F.col("cut_cell")), F.lit(1))
        .when((_cell(rank) == F.col("cut_cell")) & (rank <= F.col("last_rank")), F.lit(1))
        .otherwise(F.lit(0))
    )
    return found.withColumn("copies", F.col("whole") + one).drop("whole", "p", "cut_cell", "last_rank")


def mix(docs: DataFrame) -> DataFrame:
    """Documents with their copies: the columns of ``docs`` and size, source_size, target, copies, taken."""
    rows = sized(docs.select("doc_id", "source", "text")).select("doc_id", "source", "mix_size", "mix_draw")
    rows = materialise(rows, "mix-rows")
    return decide(rows, plan_mix(rows)).select(
        "doc_id", F.col("mix_size").alias("size"), "source_size", "target",
        (F.col("mix_size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as it is taken."""
    # The rows travel whole in one column, so their own names never meet those of the plan.
    held = sized(docs.select("doc_id", "source", "text", F.struct("*").alias("held_row"))).drop("text")
    rows = materialise(held.select("source", "mix_size", "mix_draw"), "mix-rows")
    chosen = decide(held, plan_mix(rows)).where("copies > 0")
    copies = F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long"))
    return chosen.select("held_row", F.explode(copies).alias("copy")).select("held_row.*")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = f"""
WITH rows AS (
  SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 13) AS BIGINT)
      AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS w
  FROM rows GROUP BY source),
levels AS (SELECT *, row_number() OVER o AS k,
    CAST(sum(s) OVER () - coalesce(sum(3 * s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM sizes WINDOW o AS (ORDER BY CAST(3 * s AS DOUBLE) / w, source ASC NULLS LAST)),
chosen AS (SELECT coalesce(min_by(level, k) FILTER (level <= CAST(3 * s AS DOUBLE) / w), 0.0) AS shared FROM levels),
goals AS (SELECT source, s, least(shared * w, CAST(3 * s AS DOUBLE)) AS target FROM sizes, chosen),
parts AS (SELECT *, CASE WHEN s > 0 THEN target / s ELSE 0.0 END AS r FROM goals),
ranked AS (SELECT rows.*, s, target, floor(r) AS whole, r - floor(r) AS p, target - floor(r) * s AS missing,
    (u / (1 - u)) / nullif((r - floor(r)) / (1 - (r - floor(r))), 0) AS q
  FROM rows JOIN parts ON rows.source IS NOT DISTINCT FROM parts.source),
summed AS (SELECT *, sum(size) OVER (PARTITION BY source, q) AS words,
    sum(size) OVER (PARTITION BY source ORDER BY q) - sum(size) OVER (PARTITION BY source, q) AS start FROM ranked)
SELECT doc_id, size, s AS source_size, target, CAST(size * copies AS BIGINT) AS taken, copies FROM (
  SELECT *, CAST(whole + CASE WHEN p > 0 AND start + words / 2.0 <= missing THEN 1 ELSE 0 END AS BIGINT) AS copies FROM summed)
"""
