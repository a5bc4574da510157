"""Alignment of two tokenizers by products of sparse incidence matrices.

A (byte-level BPE) and B (sentencepiece) cut the same bytes, a space and the
text, into tokens. The matrices A and B of tokens by bytes are held as
compressed rows, and the product A.Bt, row by row (Gustavson), has an entry for
every two tokens that overlap. Where the last token that one A token meets
comes before the first one that the next A token meets, both end at one byte: the
groups of the text. Products of the incidence with groups then give all links
of tokens that share a group; equal ids of a group are one row or column with
their number as its entry, so a group that repeats itself stays small.

Both tokenizers always end a token before a space that stands alone, if no
piece of B holds the character before it and a space behind it (which is read
off its vocabulary; A's words never reach over a space). Texts are cut there,
and a task aligns each distinct segment once: documents by segments times
segments by pairs is one more product, and gives each document's pairs.

An id pair's count is the number of documents with a link of it. Counts are
summed before they are shuffled. Pairs that make up at least one of ``FREQUENT``
parts of all counts, which are at most ``FREQUENT``, are broadcast; only the rest
of a document's pairs meets the table of counts in a join.

Cases: null and empty texts, and texts whose token bytes differ from the text's
(as with U+2581, which B cannot tell from a space) have no tokens: zeros and ''.
Equal rows are documents of their own; ids may be null or repeat; an empty table
gives no rows; other columns are not looked at. Special strings are plain text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import materialise

from .byte_bpe import ByteBpe
from .shared import ranges

TOKENIZER_A = "byte_bpe_50k.json"
MODEL_B = "piece_bpe_32k.model"
#: Most pairs of ids whose counts are broadcast.
FREQUENT = 200_000
#: Distinct segments, and entries of theirs, that a task remembers before it starts again.
SEGMENTS = 200_000
ENTRIES = 2_000_000
#: Characters of texts that are aligned at once.
BATCH_CHARS = 1_000_000
#: A pair of ids as one number: A's in the high half.
ID_BITS = 32


class Rows(NamedTuple):
    """A sparse matrix by compressed rows."""

    start: np.ndarray
    column: np.ndarray
    entry: np.ndarray
    width: int


def rows_of(row: np.ndarray, column: np.ndarray, entry: np.ndarray, shape: tuple[int, int]) -> Rows:
    """The matrix of the sum of the entries given by row and column."""
    if np.any((row[1:] < row[:-1]) | ((row[1:] == row[:-1]) & (column[1:] < column[:-1]))):
        order = np.lexsort((column, row))
        row, column, entry = row[order], column[order], entry[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (column[1:] != column[:-1])
    first = np.flatnonzero(fresh)
    summed = np.add.reduceat(entry, first) if len(first) else entry
    return Rows(np.searchsorted(row[first], np.arange(shape[0] + 1)), column[first], summed, shape[1])


def product(one: Rows, other: Rows) -> Rows:
    """Gustavson: entry k of a row of ``one`` adds that multiple of row k of ``other`` to the row."""
    height = len(one.start) - 1
    row = np.repeat(np.arange(height), np.diff(one.start))
    length = np.diff(other.start)[one.column]
    at = ranges(other.start[one.column], length)
    return rows_of(np.repeat(row, length), other.column[at], np.repeat(one.entry, length) * other.entry[at], (height, other.width))


def transposed(matrix: Rows) -> Rows:
    height = len(matrix.start) - 1
    row = np.repeat(np.arange(height), np.diff(matrix.start))
    return rows_of(matrix.column, row, matrix.entry, (matrix.width, height))


def token_bytes(lengths: np.ndarray) -> Rows:
    """Tokens by bytes, from the tokens' lengths: each token has the bytes after those of the tokens before."""
    total = int(lengths.sum())
    return Rows(np.concatenate([[0], np.cumsum(lengths)]), np.arange(total), np.ones(total, "int64"), total)


def token_groups(overlaps: Rows) -> tuple[np.ndarray, np.ndarray]:
    """The group of every A token and every B token, from the overlaps A.Bt, in which no row or column is empty."""
    first, last = overlaps.column[overlaps.start[:-1]], overlaps.column[overlaps.start[1:] - 1]
    of_a = np.concatenate([[0], np.cumsum(first[1:] > last[:-1])]) if len(first) else np.empty(0, "int64")
    of_b = np.empty(overlaps.width, "int64")
    of_b[overlaps.column] = np.repeat(of_a, np.diff(overlaps.start))
    return of_a, of_b


def shared_links(of_a: np.ndarray, ids_a: np.ndarray, of_b: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, pair and number of links of every two ids that share a group."""
    n = int(of_a[-1]) + 1 if len(of_a) else 0
    key_a, times_a = np.unique(of_a << ID_BITS | ids_a, return_counts=True)
    key_b, times_b = np.unique(of_b << ID_BITS | ids_b, return_counts=True)
    a = Rows(np.arange(len(key_a) + 1), key_a >> ID_BITS, times_a, n)
    b = Rows(np.searchsorted(key_b >> ID_BITS, np.arange(n + 1)), np.arange(len(key_b)), times_b, len(key_b))
    links = product(a, b)
    mask = (1 << ID_BITS) - 1
    row = np.repeat(key_a, np.diff(links.start))
    return row >> ID_BITS, (row & mask) << ID_BITS | key_b[links.column] & mask, links.entry


class Tokenizers:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import re

        import sentencepiece

        self.a = ByteBpe(path_a, special=False)
        self.bytes_a = self.a.octets
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        joined = {x for p in pieces for x, y in zip(p, p[1:]) if y == "▁" and x != "▁"}
        self.sizes_a = np.zeros(max(self.bytes_a) + 1, "int64")
        for at, octets in self.bytes_a.items():
            self.sizes_a[at] = len(octets)
        self.sizes_b = np.array([len(x) for x in self.bytes_b], "int64")
        # Ids as text, with the mark behind an id inside a group and behind the last one.
        self.text_a = np.array([f"{k}{mark}" for mark in ",|" for k in range(len(self.sizes_a))], object)
        self.text_b = np.array([f"{k}{mark}" for mark in ",;" for k in range(len(self.sizes_b))], object)
        held = "".join(map(re.escape, sorted(joined)))
        self.alone = re.compile(rf"(?<=[^\s{held}]) (?=\S)")
        # Parts whose ends a token may cross when a space and more text stand there: encoded by themselves.
        self.lone = re.compile(rf"\A(?:\s|\Z)|[\s{held}]\Z")

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bool]]:
        """Ids and their number per part, of A and of B, and whether the bytes of both are the part's behind a space; parts whose are not have none.

        Parts that neither begin nor end with white space are encoded as one text, cut where their bytes end (``_joint``);
        the others, whose white space would join that between the parts, one by one.
        """
        lone = np.array([bool(self.lone.search(part)) for part in parts], bool)
        order = np.concatenate([np.flatnonzero(~lone), np.flatnonzero(lone)])
        found = [self._joint([parts[k] for k in some]) for some in (np.flatnonzero(~lone), *np.flatnonzero(lone)[:, None])]
        place = np.empty(len(parts), "int64")
        place[order] = np.arange(len(parts))
        out = []
        for side in (0, 2):
            ids, n = (np.concatenate([x[side + k] for x in found]) for k in (0, 1))
            out += [ids[ranges((np.cumsum(n) - n)[place], n[place])], n[place]]
        good = [ok for x in found for ok in x[4]]
        return *out, [good[k] for k in place]

    def _joint(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bool]]:
        """``encode`` of parts as one text; where that text's bytes differ, or a token crosses a part's end, of its halves."""
        good = ["▁" not in part for part in parts]
        kept = [part for part, ok in zip(parts, good) if ok]
        if not kept:
            return np.empty(0, "int64"), np.zeros(len(parts), "int64"), np.empty(0, "int64"), np.zeros(len(parts), "int64"), good
        text = " ".join(kept)
        octets = (" " + text).encode()
        a = self.a.ids(" " + text).astype("int64")
        b = np.array(self.b.encode(text, num_threads=1), "int64")
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) == octets == b"".join(map(self.bytes_b.__getitem__, b.tolist())):
            ends = np.cumsum([1 + len(part) if part.isascii() else 1 + len(part.encode()) for part in kept])
            stops = [np.cumsum(sizes[ids]) for ids, sizes in ((a, self.sizes_a), (b, self.sizes_b))]
            last = [np.searchsorted(x, ends) for x in stops]
            if all(np.array_equal(x[at], ends) for x, at in zip(stops, last)):
                counts = np.zeros((2, len(parts)), "int64")
                counts[:, np.flatnonzero(good)] = [np.diff(at + 1, prepend=0) for at in last]
                return a, counts[0], b, counts[1], good
        if len(kept) > 1:
            # Some part spoils the whole: halves are tried by themselves.
            half = len(parts) // 2
            low, high = self._joint(parts[:half]), self._joint(parts[half:])
            return *(np.concatenate([x, y]) for x, y in zip(low[:4], high[:4])), low[4] + high[4]
        return np.empty(0, "int64"), np.zeros(len(parts), "int64"), np.empty(0, "int64"), np.zeros(len(parts), "int64"), [False] * len(parts)

    def segments(self, text: str) -> list[str]:
        """The text, cut at spaces before which both tokenizers end a token; the spaces themselves are left out."""
        return self.alone.split(text)


class Segments:
    """What is known of the segments that a task has met, by their number."""

    def __init__(self, both: Tokenizers):
        self.both = both
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.sizes = np.empty((0, 4), "int64")  # A tokens, B tokens, groups, links
        self.good = np.empty(0, bool)
        self.groups: list[str] = []  # with a mark at the end
        self.start = np.zeros(1, "int64")
        self.pair, self.times = np.empty(0, "int64"), np.empty(0, "int64")

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of the segments of each text; new ones are aligned."""
        if len(self.number) > SEGMENTS or len(self.pair) > ENTRIES:
            self.clear()
        known, fresh, out = self.number, [], []
        for text in texts:
            parts = self.both.segments(text)
            found = list(map(known.get, parts))
            if None in found:
                for at, part in enumerate(parts):
                    if found[at] is None:
                        if part not in known:
                            known[part] = len(known)
                            fresh.append(part)
                        found[at] = known[part]
            out.append(np.array(found, "int64"))
        if fresh:
            self._align(fresh)
        return out

    def _align(self, fresh: list[str]) -> None:
        both = self.both
        flat_a, n_a, flat_b, n_b, good = both.encode(fresh)
        size_a, size_b = both.sizes_a[flat_a], both.sizes_b[flat_b]
        of_a, of_b = token_groups(product(token_bytes(size_a), transposed(token_bytes(size_b))))
        group, pair, times = shared_links(of_a, flat_a, of_b, flat_b)

        n = int(of_a[-1]) + 1 if len(of_a) else 0
        owner = np.empty(n, "int64")
        owner[of_a] = np.repeat(np.arange(len(fresh)), n_a)
        n_groups = np.bincount(owner, minlength=len(fresh))
        pairs = np.unique(pair)
        by_segment = rows_of(owner[group], np.searchsorted(pairs, pair), times, (len(fresh), len(pairs)))
        n_links = np.bincount(np.repeat(np.arange(len(fresh)), np.diff(by_segment.start)), by_segment.entry, len(fresh)).astype("int64")
        # A group's text: its ids of A, then those of B, each with the mark that follows it.
        in_a, in_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
        ends_a, ends_b = np.cumsum(in_a), np.cumsum(in_b)
        marked = np.empty(len(flat_a) + len(flat_b), object)
        last = np.zeros(len(flat_a), "int64")
        last[ends_a - 1] = 1
        marked[np.arange(len(flat_a)) + (ends_b - in_b)[of_a]] = both.text_a[flat_a + last * len(both.sizes_a)]
        last = np.zeros(len(flat_b), "int64")
        last[ends_b - 1] = 1
        marked[np.arange(len(flat_b)) + ends_a[of_b]] = both.text_b[flat_b + last * len(both.sizes_b)]
        marked, stops = marked.tolist(), np.cumsum(n_a + n_b).tolist()
        self.groups += ["".join(marked[low:high]) for low, high in zip([0, *stops], stops)]
        self.sizes = np.concatenate([self.sizes, np.stack([n_a, n_b, n_groups, n_links], 1)])
        self.good = np.concatenate([self.good, good])
        self.start = np.concatenate([self.start, self.start[-1] + by_segment.start[1:]])
        self.pair = np.concatenate([self.pair, pairs[by_segment.column]])
        self.times = np.concatenate([self.times, by_segment.entry])

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], Rows, np.ndarray]:
        """Sizes and groups of each text, and documents by pairs, whose columns the last array names."""
        numbers = self.numbers([x or "" for x in texts])
        has = np.array([bool(x) and bool(self.good[at].all()) for x, at in zip(texts, numbers)], bool)
        numbers = [at if ok else at[:0] for at, ok in zip(numbers, has)]
        lengths = np.array([len(x) for x in numbers], "int64")
        row, flat = np.repeat(np.arange(len(texts)), lengths), np.concatenate(numbers)
        sizes = np.zeros((len(texts), 4), "int64")
        np.add.at(sizes, row, self.sizes[flat])
        groups = ["".join(map(self.groups.__getitem__, x.tolist()))[:-1] for x in numbers]
        used = np.unique(flat)
        held = rows_of(row, np.searchsorted(used, flat), np.ones(len(flat), "int64"), (len(texts), len(used)))
        count = np.diff(self.start)[used]
        at = ranges(self.start[used], count)
        pairs, column = np.unique(self.pair[at], return_inverse=True)
        by_pair = Rows(np.concatenate([[0], np.cumsum(count)]), column, self.times[at], len(pairs))
        return sizes, groups, product(held, by_pair), pairs


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """The texts, a bounded number of characters at a time (a longer one by itself)."""
    held, chars, start = [], 0, 0
    for k, value in enumerate(texts):
        held.append(value.as_py())
        chars += len(held[-1] or "") + 100
        if chars >= BATCH_CHARS:
            yield start, held
            held, chars, start = [], 0, k + 1
    if held:
        yield start, held


def _paths(tokenizer_a: str | None, model_b: str | None) -> tuple[str, str]:
    return tokenizer_a or public_tokenizers.path(TOKENIZER_A), model_b or public_tokenizers.path(MODEL_B)


def encoded(docs: DataFrame, tokenizer_a: str | None = None, model_b: str | None = None,
            doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the pairs of ids with the number of their links."""
    paths = _paths(tokenizer_a, model_b)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([
        *rows.schema.fields[:2], *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")),
        T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType())),
        T.StructField("times", T.ArrayType(T.LongType()))])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = Segments(Tokenizers(*paths))
        for batch in batches:
            for start, texts in _slices(batch.column(2)):
                sizes, groups, held, pairs = segments.documents(texts)
                hashes = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in groups]
                offsets = pa.array(held.start, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(start, len(texts)) for k in (0, 1)), *(pa.array(sizes[:, k]) for k in range(4)),
                     pa.array(hashes, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(pairs[held.column], pa.int64())),
                     pa.ListArray.from_arrays(offsets, pa.array(held.entry, pa.int64()))], names=[f.name for f in schema.fields])

    return rows.mapInArrow(align, schema)


def spans(docs: DataFrame, tokenizer_a: str | None = None, model_b: str | None = None,
          doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The groups themselves: doc_id, group, start and stop (bytes of space and text), ids_a, ids_b."""
    paths = _paths(tokenizer_a, model_b)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ids = T.ArrayType(T.LongType())
    schema = T.StructType([
        rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("group", "start", "stop")),
        T.StructField("ids_a", ids), T.StructField("ids_b", ids)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = Segments(Tokenizers(*paths))
        for batch in batches:
            for start, texts in _slices(batch.column(1)):
                for k, groups in enumerate(segments.documents(texts)[1]):
                    sides = [[list(map(int, side.split(","))) for side in group.split("|")] for group in groups.split(";")] if groups else []
                    stops = np.cumsum([sum(len(segments.both.bytes_a[x]) for x in a) for a, _ in sides], dtype="int64")
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([start + k] * len(sides), pa.int64())), pa.array(np.arange(len(sides))),
                         pa.array(np.concatenate([[0], stops[:-1]])[:len(sides)], pa.int64()), pa.array(stops),
                         pa.array([a for a, _ in sides], pa.list_(pa.int64())), pa.array([b for _, b in sides], pa.list_(pa.int64()))],
                        names=[f.name for f in schema.fields])

    return rows.mapInArrow(cut, schema)


def pair_counts(stored: DataFrame) -> DataFrame:
    """pair, count (documents that hold it linked) and best (no pair of its A id has more), stored."""
    counts = stored.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    counts = materialise(counts, "align-counts")
    id_a = F.shiftright("pair", ID_BITS)
    most = counts.groupBy(id_a.alias("a")).agg(F.max("count").alias("most"))
    rated = counts.withColumn("a", id_a).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    return materialise(rated, "align-rated")


def _frequent(counts: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted pairs with at least one of ``parts`` parts of all counts, which cannot be more than ``parts``; counts, best."""
    total = counts.agg(F.sum("count")).first()[0] or 0
    table = counts.where(F.col("count") * parts >= total).toArrow()
    pair = table.column("pair").to_numpy()
    order = np.argsort(pair)
    return pair[order], table.column("count").to_numpy()[order], table.column("best").to_numpy(zero_copy_only=False)[order].astype("int64")


def _valued(stored: DataFrame, counts: DataFrame, parts: int) -> DataFrame:
    """``stored`` with n_best and count_sum over frequent pairs, and the pairs left with their times."""
    shared = stored.sparkSession.sparkContext.broadcast(_frequent(counts, parts))
    kept = [f for f in stored.schema.fields if f.name not in ("pairs", "times")]
    lists = T.ArrayType(T.LongType())
    schema = T.StructType([*kept, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()),
                           T.StructField("pairs", lists), T.StructField("times", lists)])

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = shared.value
        for batch in batches:
            lists, times = batch.column(len(kept)), batch.column(len(kept) + 1).flatten().to_numpy()
            pairs = lists.flatten().to_numpy()
            length = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), length)
            at = np.searchsorted(known, pairs)
            found = np.zeros(len(pairs), bool)
            inside = at < len(known)
            found[inside] = known[at[inside]] == pairs[inside]
            n_best, count_sum = np.zeros(batch.num_rows, "int64"), np.zeros(batch.num_rows, "int64")
            np.add.at(n_best, row[found], times[found] * best[at[found]])
            np.add.at(count_sum, row[found], times[found] * count[at[found]])
            rest = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[~found], minlength=batch.num_rows))]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(kept)], pa.array(n_best), pa.array(count_sum),
                 *(pa.ListArray.from_arrays(rest, pa.array(x[~found])) for x in (pairs, times))], names=[f.name for f in schema.fields])

    return stored.select(*(f.name for f in kept), "pairs", "times").mapInArrow(value, schema)


def aligned(docs: DataFrame, frequent: int = FREQUENT, **named) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    stored = materialise(encoded(docs, **named), "align-encoded")
    counts = pair_counts(stored)
    valued = materialise(_valued(stored, counts, frequent), "align-valued")
    rest = valued.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", "link.pairs", "link.times")
    rest = rest.join(counts, rest["pairs"] == counts["pair"]).groupBy("row").agg(
        F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("count")).alias("more_sum"))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    whole = F.size("pairs") == 0
    joined = valued.where(~whole).join(rest, "row").select(
        *columns, (F.col("n_best") + F.col("more_best")).alias("n_best"), (F.col("count_sum") + F.col("more_sum")).alias("count_sum"), "groups_sha256")
    return valued.where(whole).select(*columns, "n_best", "count_sum", "groups_sha256").unionByName(joined)


def op12_alignment(spark, sf_dir: str) -> DataFrame:
    return aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
