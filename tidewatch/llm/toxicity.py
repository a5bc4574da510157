"""Toxicity scores by a factorization machine over hashed terms.

The terms of a text are its words and their first four letters, lower-cased
and hashed; a text has a term or not, however long it is. The machine learns a
weight and a short factor vector per term, so that two terms which together
mark a toxic text (an insult and a mention of a group) count beyond the sum of
their weights. It is fitted on a sample of labelled rows, at most
``SAMPLE_ROWS`` of them by the smallest hash of their id, over the hash
buckets that differ between the labels (with a chi-square of at least ``CHI_SQUARE``,
or of a quarter of the rows where there are few) and those that a fair share of
the rows hold (``COMMON``), since two of them may mark a text together that do not
alone. Equal texts are learned from once. Only those bucket numbers, which are
terms of the sample, and the fitted weights reach the driver.

Cases: null and empty texts have no term and get the score of none; without
labelled rows of both kinds every score is the share of toxic rows, 0 if there
are no rows; rows with a null id are never held out and never learned from;
equal rows get equal scores; other columns are kept and not looked at.
"""

from __future__ import annotations

from pyspark.ml.classification import FMClassificationModel, FMClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import materialise

from .shared import free_name

BUCKETS = 2**20
SAMPLE_ROWS = 20_000
FACTORS = 4
ROUNDS = 60
STEP = 0.1
PENALTY = 0.01
CHI_SQUARE = 30.0
#: Share of the rows, of either label, from which on a term is learned whatever its chi-square.
COMMON = 0.25
FOLDS = 5
THRESHOLD = 0.5


def fold(doc_id: str) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def terms(text: str) -> Column:
    """Distinct hash buckets of a text's words and word beginnings, as text."""
    words = F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")), "")
    starts = F.array_distinct(F.transform(words, lambda w: F.concat(F.substring(w, 1, 4), F.lit("*"))))
    return F.transform(F.array_union(words, starts), lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("string"))


class Scorer:
    """A fitted model, or a constant where there was nothing to fit."""

    def __init__(self, constant: float, vectors: CountVectorizerModel | None = None, model: FMClassificationModel | None = None):
        self.constant, self.vectors, self.model = constant, vectors, model

    def score(self, docs: DataFrame, text: str = "text", column: str = "score") -> DataFrame:
        """Add the score to each row, under ``column`` with underscores added if it is taken; the other columns stay as they are."""
        column = free_name(docs, column)
        if self.model is None:
            return docs.withColumn(column, F.lit(self.constant))
        held = docs.select(F.struct("*").alias("held_row"), terms(text).alias("held_terms"))
        scored = self.model.transform(self.vectors.transform(held))
        return scored.select("held_row.*", vector_to_array("held_odds")[1].alias(column))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """Learn from the rows of ``labels`` outside the held-out fold."""
    known = labels.select(F.col(doc_id).alias("label_id"), F.col(label).cast("double").alias("label")).where(
        F.col("label").isNotNull() & (fold("label_id") != 0))
    sample = known.orderBy(F.xxhash64("label_id"), "label_id", "label").limit(sample_rows)
    sample = materialise(sample, "toxic-sample")
    # At most sample_rows pairs of numbers, so the broadcast has a fixed bound. Terms are hashed behind the join.
    rows = docs.select(F.col(doc_id).alias("label_id"), F.col(text).alias("held_text")).join(F.broadcast(sample), "label_id")
    rows = materialise(rows.select("label", terms("held_text").alias("held_terms")).dropDuplicates(), "toxic-rows")
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if positive == 0 or positive == n:
        return Scorer(positive / n if n else 0.0)
    has, toxic, share = F.count("*"), F.sum("label"), positive / n
    counts = rows.select("label", F.explode("held_terms").alias("term")).groupBy("term").agg(has.alias("has"), toxic.alias("toxic"))
    lead = F.col("toxic") - F.col("has") * share
    square = lead * lead / (F.col("has") * share * (1 - share))
    common = (F.col("toxic") >= COMMON * positive) & (F.col("toxic") <= (1 - COMMON) * positive) | (
        (F.col("has") - F.col("toxic") >= COMMON * (n - positive)) & (F.col("has") - F.col("toxic") <= (1 - COMMON) * (n - positive)))
    best = counts.where((square >= min(CHI_SQUARE, n / 4)) | common)
    vocabulary = [r["term"] for r in best.orderBy("term").select("term").collect()]
    if not vocabulary:
        return Scorer(share)
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="held_terms", outputCol="held_features").setBinary(True)
    machine = FMClassifier(
        featuresCol="held_features", labelCol="label", probabilityCol="held_odds", rawPredictionCol="held_raw", predictionCol="held_class",
        factorSize=FACTORS, maxIter=ROUNDS, stepSize=STEP, regParam=PENALTY, seed=7)
    prepared = vectors.transform(rows).select("label", "held_features").coalesce(4)
    return Scorer(share, vectors, machine.fit(materialise(prepared, "toxic-vectors").coalesce(4)))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` scored under ``threshold``, with their columns."""
    name = free_name(docs, "held_score")
    return fit(docs, labels).score(docs, column=name).where(F.col(name) < threshold).drop(name)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scorer = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scorer.score(docs).select(
        "doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
