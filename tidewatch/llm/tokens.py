"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text of more than ``chunk`` characters is cut into chunks that overlap, and
the chunks are encoded in different tasks, with offsets. Two neighbours are
spliced at the first place of their overlap where both have a token boundary
that is proven stable: no piece of the vocabulary holds the characters on its
two sides next to each other, so no merge can ever cross it and the tokens on
either side do not depend on the other. Where an overlap has no such place,
the document is done again with chunks and overlaps twice as long, until all
its splices hold or it is one chunk.

Cases: null and empty texts have 0 bytes and 0 tokens; equal rows get equal
counts, each its own row; ids may be null or repeat; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import materialise

from .shared import partitions

MODEL = "piece_bpe_32k.model"
CHUNK = 32_768
OVERLAP = 1_024
LIMIT = 4_096


def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def joined_pairs(model) -> set[str]:
    """All pairs of neighbouring characters inside pieces of the vocabulary."""
    pairs = set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        pairs.update(map("".join, zip(piece, piece[1:])))
    return pairs


def boundaries(model, pairs: set[str], text: str) -> tuple[int, list[tuple[int, int]]]:
    """Tokens of ``text``, and its stable boundaries as (character, tokens before it)."""
    found = model.encode(text, return_type="offset_mapping")["offsets"]
    marked = text.replace(" ", "▁")
    stable, last = [], 0
    for k, (at, _) in enumerate(found):
        # The bytes of one character share its offsets; only the first stands at a boundary.
        if at > last and marked[at - 1:at + 1] not in pairs:
            stable.append((at, k))
        last = max(last, at)
    return len(found), stable


def count_plain(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens of texts encoded in one go."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            tokens, sizes = [], []
            for start in range(0, batch.num_rows, 256):
                texts = [x or "" for x in batch.column(1).slice(start, 256).to_pylist()]
                tokens += [len(ids) for ids in model.encode(texts, num_threads=1)]
                sizes += [len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(count, schema)


def count_spliced(keyed: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """doc_id, text_key, n_tokens of huge texts; n_tokens is null where a splice failed."""
    key = [keyed.schema["doc_id"], keyed.schema["text_key"]]
    chunks = T.StructType([*key, T.StructField("k", T.LongType()), T.StructField("last", T.BooleanType()), T.StructField("text", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                starts = range(0, max(len(text) - overlap, 1), chunk)
                for first in range(0, len(starts), 64):
                    some = range(first, min(first + 64, len(starts)))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([batch.column(0)[i].as_py()] * len(some), batch.schema.field(0).type),
                        pa.array([batch.column(1)[i].as_py()] * len(some), pa.int64()),
                        pa.array(some, pa.int64()), pa.array([k == len(starts) - 1 for k in some]),
                        pa.array([text[starts[k]:] if k == len(starts) - 1 else text[starts[k]:starts[k] + chunk + overlap] for k in some]),
                    ], names=[f.name for f in chunks.fields])

    encoded = T.StructType([*key, T.StructField("k", T.LongType()), T.StructField("last", T.BooleanType()),
                            T.StructField("n", T.LongType()), T.StructField("head", T.ArrayType(T.LongType())), T.StructField("head_n", T.ArrayType(T.LongType())),
                            T.StructField("tail", T.ArrayType(T.LongType())), T.StructField("tail_n", T.ArrayType(T.LongType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        pairs = joined_pairs(model)
        lists = pa.list_(pa.int64())
        for batch in batches:
            n, head, head_n, tail, tail_n = [], [], [], [], []
            for k, text in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                total, stable = boundaries(model, pairs, text)
                n.append(total)
                left = [x for x in stable if x[0] <= overlap] if k else []
                right = [x for x in stable if x[0] > chunk]
                head.append([k * chunk + x for x, _ in left])
                head_n.append([x for _, x in left])
                tail.append([k * chunk + x for x, _ in right])
                tail_n.append([x for _, x in right])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(n, pa.int64()), *(pa.array(x, lists) for x in (head, head_n, tail, tail_n))],
                names=[f.name for f in encoded.fields])

    done = keyed.select("doc_id", "text_key", "text").mapInArrow(cut, chunks)
    done = done.repartition(partitions(keyed), "doc_id", "text_key", "k").mapInArrow(encode, encoded)
    done = materialise(done.dropDuplicates(["doc_id", "text_key", "k"]), "token-chunks")
    after = done.select("doc_id", "text_key", (F.col("k") - 1).alias("k"), "head", "head_n")
    before = done.select("doc_id", "text_key", "k", "last", "n", "tail", "tail_n")
    same = F.expr("before.doc_id <=> after.doc_id and before.text_key = after.text_key and before.k = after.k")
    seam = before.alias("before").join(after.alias("after"), same, "left").select(
        "before.doc_id", "before.text_key", "last", "n", "tail", "tail_n", "head", "head_n",
        F.array_min(F.array_intersect("tail", "head")).alias("at"))
    # Tokens of a chunk up to its splice, less those of the next chunk before the splice.
    share = F.when(F.col("last"), F.col("n")).otherwise(
        F.element_at("tail_n", F.array_position("tail", F.col("at")).cast("int"))
        - F.element_at("head_n", F.array_position("head", F.col("at")).cast("int")))
    return seam.groupBy("doc_id", "text_key").agg(
        F.when(F.count("*") == F.count(share), F.sum(share)).alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row."""
    path = path or public_tokenizers.path(MODEL)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    huge = F.coalesce(F.length("text") > chunk + overlap, F.lit(False))
    plain = count_plain(docs.where(~huge), path)
    rows = docs.where(huge).withColumn("text_key", F.xxhash64("text"))
    sizes = materialise(rows.select("doc_id", "text_key", F.octet_length("text").cast("long").alias("n_bytes")), "token-huge")
    if sizes.isEmpty():
        return plain
    counts, pending = None, rows
    while True:
        found = materialise(count_spliced(pending, path, chunk, overlap), "token-counts")
        good = found.where("n_tokens is not null")
        counts = good if counts is None else counts.unionByName(good)
        failed = found.where("n_tokens is null").select(F.col("doc_id").alias("failed_id"), F.col("text_key").alias("failed_key"))
        if failed.isEmpty():
            break
        chunk, overlap = 2 * chunk, 2 * overlap
        pending = rows.join(failed, F.expr("doc_id <=> failed_id and text_key = failed_key"), "left_semi")
    counts = counts.select(F.col("doc_id").alias("counted_id"), F.col("text_key").alias("counted_key"), "n_tokens")
    return plain.unionByName(
        sizes.join(counts, F.expr("doc_id <=> counted_id and text_key = counted_key")).select("doc_id", "n_bytes", "n_tokens"))


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    counted = count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
