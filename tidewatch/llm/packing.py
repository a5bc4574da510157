"""Best-fit packing by minimum bin slack.

Documents become token ids (tokenizers' byte-level BPE, then one end id) and
pieces of at most 1,024 tokens. Sequences are filled one kind at a time: the
longest piece left opens a sequence, a bitset subset-sum over the lengths that
are left, each as often as it is left, finds the fullest feasible filling, and
that combination is removed as often as the pieces allow (the search would
find it again until then). Only the histogram of lengths, at most 1,024 rows
whatever the corpus, reaches the driver, and only the list of combinations
goes back. Pieces find their place from their rank among the pieces of their
length, which is counted in hash buckets, so a length that most pieces have
is no single task's work.

Cases: a null or empty text is the end id alone; equal rows are packed each on
its own; ids may be null or repeat; an empty table gives no rows. Special
strings inside texts get their own ids, as the library does by default.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import materialise

from .byte_bpe import ByteBpe
from .shared import id_type

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
#: Pieces per bucket in which ranks are counted.
BUCKET_ROWS = 2048


def pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY,
           doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``, the number of the row and, if asked for, the ``ids``.

    A document longer than ``capacity`` is cut into pieces of that length, of
    which the first takes the remainder.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    kind = id_type(docs, doc_id)
    fields = [T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("row", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path, special=True)
        for batch in batches:
            rows = []
            for i, value in enumerate(batch.column(1)):
                ids = np.append(bpe.ids(value.as_py() or ""), np.uint32(end_id)).astype("<u4")
                n = len(ids)
                first = n - (n - 1) // capacity * capacity
                start, stop, piece = 0, first, 0
                while start < n:
                    part = ids[start:stop]
                    rows.append((i, piece, start, stop - start, zlib.crc32(part), part))
                    start, stop, piece = stop, stop + capacity, piece + 1
            at, *columns, part = zip(*rows) if rows else [[]] * 6
            at = pa.array(at, pa.int64())
            out = [batch.column(0).take(at), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:]), batch.column(2).take(at)]
            if with_ids:
                out.append(pa.array([x.astype("int64") for x in part], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(cut, T.StructType(fields))


def fullest(lengths: list[int], left: dict[int, int], room: int) -> dict[int, int]:
    """The combination of ``left`` (length: count) that fills most of ``room``.

    Bit s of the set is on if s tokens can be filled. Lengths come longest
    first, each in doubling multiples up to its count, and the search ends
    when the room can be filled wholly.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        if length > room:
            continue
        count, many = min(left[length], room // length), 1
        while count > 0 and not reach >> room & 1:
            take = min(many, count)
            after = (reach | reach << (length * take)) & mask
            if after != reach:
                steps.append((length, take, reach))
                reach = after
            count -= take
            many *= 2
        if reach >> room & 1:
            break
    fill, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> fill & 1:
            chosen[length] = chosen.get(length, 0) + take
            fill -= length * take
    return chosen


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations (length: count) and how often each is used; all pieces are used up."""
    left = {length: n for length, n in sorted(histogram.items(), reverse=True) if n > 0}
    plan = []
    while left:
        longest = next(iter(left))
        left[longest] -= 1
        lengths = [x for x, n in left.items() if n > 0]
        combination = fullest(lengths, left, capacity - longest)
        left[longest] += 1
        combination[longest] = combination.get(longest, 0) + 1
        times = min(left[x] // n for x, n in combination.items())
        for x, n in combination.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        plan.append((combination, times))
    return plan


def places(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per length, rows of (first rank, pieces per sequence, first sequence, offset), by rank."""
    used: dict[int, int] = {}
    out: dict[int, list] = {}
    sequence = 0
    for combination, times in plan:
        offset = 0
        for length in sorted(combination, reverse=True):
            n = combination[length]
            out.setdefault(length, []).append((used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return {length: np.array(rows, "int64") for length, rows in out.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces of at most ``capacity`` tokens, and drop the number of their row."""
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not histogram:
        return cut.drop("row").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    table = places(plan_sequences(histogram, capacity))
    buckets = -(-sum(histogram.values()) // BUCKET_ROWS)
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select(
        "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    starts = materialise(starts, "pack-starts")
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row", "piece")) - 1
    ranked = dealt.withColumn("within", within).join(starts, ["length", "bucket"]).withColumn(
        "rank", F.col("within") + F.col("before")).select(*cut.columns, "rank")
    out_schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at_length, at_rank = cut.columns.index("length"), len(cut.columns)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(at_length).to_numpy(), batch.column(at_rank).to_numpy()
            sequence, offset = np.empty(len(length), "int64"), np.empty(len(length), "int64")
            for one in np.unique(length):
                rows = np.flatnonzero(length == one)
                found = table[int(one)][np.searchsorted(table[int(one)][:, 0], rank[rows], "right") - 1]
                over = rank[rows] - found[:, 0]
                sequence[rows] = found[:, 2] + over // found[:, 1]
                offset[rows] = found[:, 3] + over % found[:, 1] * one
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at_rank], pa.array(sequence), pa.array(offset)], names=[f.name for f in out_schema.fields])

    return ranked.mapInArrow(place, out_schema).drop("row")


def pack_documents(docs: DataFrame, with_ids: bool = False, **named) -> DataFrame:
    """Pieces of ``docs`` with their place in the sequences."""
    return pack(materialise(pieces(docs, with_ids=with_ids, **named), "pack-pieces"))


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
