"""Near duplicates of embeddings by PCA-ordered tiled comparison.

Vectors are scaled to length 1 and turned into the basis of the principal
components, widest first. Distinct vectors are dealt into blocks that lie
together: the first components are cut at quantiles, and vectors are ordered by
the first bits of these shares, then the second, and so on. Blocks are stored
once, packed, and meet in a cartesian product that reads them anew, so disk
grows with the table and not with the pairs. A pair of blocks is left out when the boxes around their leading components are
farther apart than linked vectors can be. Inside the others the products are
added up over groups of leading components; what the rest can still add is
bounded by the product of the two suffix norms (Cauchy-Schwarz), and a pair
is dropped as soon as it cannot reach the threshold. Pairs that come through
are decided by their cosine in double precision from the given components.

A task returns how many links each of its vectors has and a spanning forest
of them, never the pairs, so a large group of near copies costs rows in
proportion to its members. Equal vectors are one, with a count.

Cases: vectors that are null, empty, zero or hold null or non-finite values
link with nothing, equal ones included; vectors of different length do not
link; a null id is not a component unless it stands alone; an empty table gives
no rows; labels and other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import materialise

from .shared import components, partitions

THRESHOLD = 0.95
#: Distinct vectors per block, and leading components that blocks are cut along.
BLOCK = 2048
LEADING = 8
#: Each leading component is cut into 2 ** BITS shares; blocks of a stored file at least, if there are more than partitions.
BITS = 4
FILE_BLOCKS = 16
#: Components are added up to these counts before the rest is bounded.
STEPS = (8, 16, 32)
#: Room for rounding in the bounds; the final cosine decides.
SLACK = 1e-5
TILE = 1024
#: Unpacked blocks that a task keeps, and rows of counts after which it adds them up.
HELD = 32
COUNTS = 1_000_000


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), "float64").reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: str):
    """Whether a vector has a direction."""
    v = F.col(vector)
    good = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(good & F.exists(v, lambda x: x != 0), F.lit(False))


def principal_axes(vectors: DataFrame, size: int) -> np.ndarray:
    """Principal axes of unit vectors, widest first: size * size sums come to the driver."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            x = _units(_matrix(batch.column(0)))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["row", "sums"])

    parts = vectors.select("vector").mapInArrow(sums, "row int, sums array<double>")
    added = parts.select("row", F.posexplode("sums").alias("column", "x")).groupBy("row", "column").agg(F.sum("x").alias("x"))
    total = np.zeros((size, size))
    for r in added.collect():
        total[r["row"], r["column"]] = r["x"]
    _, axes = np.linalg.eigh(total)
    return np.ascontiguousarray(axes[:, ::-1])


def _leading(vectors: DataFrame, axes: np.ndarray) -> list[list[float]]:
    """Per leading component, the borders between ``2 ** BITS`` equal shares of the vectors; they are approximate."""
    lead = min(LEADING, axes.shape[1])
    schema = ", ".join(f"p{k} double" for k in range(lead))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _units(_matrix(batch.column(0))) @ axes[:, :lead]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in x.T], names=[f"p{k}" for k in range(lead)])

    shares = [k / 2**BITS for k in range(1, 2**BITS)]
    parts = vectors.select("vector").mapInArrow(turn, schema)
    return [list(x) for x in parts.agg(*[F.percentile_approx(f"p{k}", shares, 1000) for k in range(lead)]).first()]


def _cells(x: np.ndarray, borders: list[list[float]]) -> np.ndarray:
    """The cell of each row of leading components: the first bits of all their shares, then the second bits, and so on."""
    shares = [np.searchsorted(np.array(b), x[:, k]) for k, b in enumerate(borders)]
    cell = np.zeros(len(x), "int64")
    for bit in reversed(range(BITS)):
        for share in shares:
            cell = 2 * cell + (share >> bit & 1)
    return cell


def _packed(vectors: DataFrame, axes: np.ndarray, borders: list[list[float]], n: int) -> DataFrame:
    """Distinct ``vectors`` (node, vector, copies) in blocks of at most ``BLOCK`` rows that lie in neighbouring cells, a row per block.

    ``mark`` is a node of the block and tells blocks apart; ``low`` and ``high`` are the box of its leading components.
    """
    coded = T.StructType([*vectors.select("node", "vector", "copies").schema.fields, T.StructField("cell", T.LongType())])
    kind = vectors.schema["vector"].dataType.elementType
    dtype = "float32" if kind == T.FloatType() else "float64"

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _units(_matrix(batch.column(1))) @ axes[:, :len(borders)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_cells(x, borders))], names=coded.names)

    def block(node: np.ndarray, copies: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        turned = _units(x.astype("float64")) @ axes[:, :len(borders)]
        return pa.RecordBatch.from_pylist([{
            "mark": int(node[0]), "node": node.tobytes(), "copies": copies.tobytes(), "vector": x.tobytes(),
            "low": turned.min(0).tolist(), "high": turned.max(0).tolist()}])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, "int64"), np.empty(0, "int64"), np.empty((0, axes.shape[0]), dtype)]
        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(2).to_numpy(), _matrix(batch.column(1)).astype(dtype)]
            held = [np.concatenate(x) for x in zip(held, new)]
            # What is left is at most two blocks, so that the last one is not much smaller.
            while len(held[0]) > 2 * BLOCK:
                yield block(*(x[:BLOCK] for x in held))
                held = [x[BLOCK:] for x in held]
        for part in zip(*(np.array_split(x, -(-len(held[0]) // BLOCK)) for x in held)) if len(held[0]) else ():
            yield block(*part)

    blocks = -(-n // BLOCK)
    parts = min(blocks, max(partitions(vectors), blocks // FILE_BLOCKS))
    dealt = vectors.select("node", "vector", "copies").mapInArrow(code, coded).repartitionByRange(parts, "cell", "node")
    return dealt.sortWithinPartitions("cell", "node").mapInArrow(
        pack, "mark long, node binary, copies binary, vector binary, low array<double>, high array<double>")


def _tile_links(a: dict, b: dict, same: bool, threshold: float):
    """Links between two blocks: per vector the weighted number, and the edges of a spanning forest."""
    count_a, count_b = np.zeros(len(a["node"]), "int64"), np.zeros(len(b["node"]), "int64")
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    forest = []
    size = a["turned"].shape[1]
    steps = [s for s in STEPS if s < size]
    for i in range(0, len(a["node"]), TILE):
        for j in range(i if same else 0, len(b["node"]), TILE):
            x, y = a["turned"][i:i + TILE], b["turned"][j:j + TILE]
            first = steps[0] if steps else size
            products = x[:, :first] @ y[:, :first].T
            rest_x, rest_y = np.sqrt(np.maximum(0, 1 - (x[:, :first] ** 2).sum(1))), np.sqrt(np.maximum(0, 1 - (y[:, :first] ** 2).sum(1)))
            r, c = np.nonzero(products + np.outer(rest_x, rest_y) >= threshold - SLACK)
            if same and i == j:
                r, c = r[r < c], c[r < c]
            products = products[r, c]
            for at, until in zip(steps, [*steps[1:], size]):
                if not len(r):
                    break
                products = products + np.einsum("ij,ij->i", x[r, at:until], y[c, at:until])
                suffix = np.sqrt(np.maximum(0, 1 - (x[:, :until] ** 2).sum(1))[r] * np.maximum(0, 1 - (y[:, :until] ** 2).sum(1))[c])
                keep = products + suffix >= threshold - SLACK
                r, c, products = r[keep], c[keep], products[keep]
            if not len(r):
                continue
            r, c = r + i, c + j
            exact = np.einsum("ij,ij->i", a["unit"][r], b["unit"][c])
            r, c = r[exact >= threshold], c[exact >= threshold]
            np.add.at(count_a, r, b["copies"][c])
            np.add.at(count_b, c, a["copies"][r])
            for u, v in zip(a["node"][r].tolist(), b["node"][c].tolist()):
                u_root, v_root = root(u), root(v)
                if u_root != v_root:
                    parent[u_root] = v_root
                    forest.append((u, v))
    return count_a, count_b, forest


class _Links:
    """What a task has found: links per node, and the edges of a spanning forest over all its pairs of blocks."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows, self.limit = 0, COUNTS
        self.parent: dict[int, int] = {}
        self.forest: list[tuple[int, int]] = []

    def _root(self, x: int) -> int:
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def add(self, node: np.ndarray, count: np.ndarray, forest: list[tuple[int, int]]) -> None:
        some = count > 0
        self.parts.append((node[some], count[some]))
        self.rows += int(some.sum())
        if self.rows > self.limit:
            # At most the nodes of the task's own blocks remain.
            self.parts = [self.counts()]
            self.rows = len(self.parts[0][0])
            self.limit = max(COUNTS, 2 * self.rows)
        for u, v in forest:
            u_root, v_root = self._root(u), self._root(v)
            if u_root != v_root:
                self.parent[u_root] = v_root
                self.forest.append((u, v))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        node, at = np.unique(np.concatenate([n for n, _ in self.parts]), return_inverse=True)
        total = np.zeros(len(node), "int64")
        np.add.at(total, at, np.concatenate([c for _, c in self.parts]))
        return node, total


def link_vectors(rows: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Links of the distinct vectors of ``rows`` (node, vector), all of one length: (node, linked), (a, b).

    Blocks are stored once; a pair of them meets in a cartesian product, which
    reads them anew, so nothing is copied on disk per pair.
    """
    n, size = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    axes = principal_axes(rows, size)
    borders = _leading(rows, axes)
    # The vectors are written only as packed blocks.
    distinct = rows.groupBy("node").agg(F.first("vector").alias("vector"), F.count("*").alias("copies"))
    blocks = materialise(_packed(distinct, axes, borders, n), "embed-blocks")
    dtype = "float32" if rows.schema["vector"].dataType.elementType == T.FloatType() else "float64"
    one = blocks.withColumnsRenamed({c: f"{c}_i" for c in blocks.columns})
    other = blocks.withColumnsRenamed({c: f"{c}_j" for c in blocks.columns})
    gap = F.aggregate(
        F.zip_with(
            F.zip_with("low_i", "high_j", lambda x, y: F.greatest(x - y, F.lit(0.0))),
            F.zip_with("low_j", "high_i", lambda x, y: F.greatest(x - y, F.lit(0.0))), lambda x, y: F.greatest(x, y)),
        F.lit(0.0), lambda total, x: total + x * x)
    near = (F.col("mark_i") <= F.col("mark_j")) & (gap <= 2 * (1 - threshold) + SLACK)
    kept = [f"{c}_{side}" for side in "ij" for c in ("mark", "node", "copies", "vector")]
    pairs = one.hint("shuffle_replicate_nl").join(other, near).select(*kept)

    def side(node: bytes, copies: bytes, vector: bytes) -> dict:
        unit = _units(np.frombuffer(vector, dtype).reshape(-1, size).astype("float64"))
        return {"node": np.frombuffer(node, "int64"), "copies": np.frombuffer(copies, "int64"), "turned": (unit @ axes).astype("float32"), "unit": unit}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, held = _Links(), {}
        for batch in batches:
            for row in range(batch.num_rows):
                met = []
                for first in (0, 4):
                    mark, *packed = (batch.column(first + k)[row] for k in range(4))
                    if mark.as_py() not in held:
                        if len(held) >= HELD:
                            # The oldest goes.
                            del held[next(iter(held))]
                        held[mark.as_py()] = side(*(x.as_py() for x in packed))
                    met.append(held[mark.as_py()])
                a, b = met
                if a is b:
                    count, more, forest = _tile_links(a, a, True, threshold)
                    links.add(a["node"], count + more, forest)
                else:
                    count, more, forest = _tile_links(a, b, False, threshold)
                    links.add(np.concatenate([a["node"], b["node"]]), np.concatenate([count, more]), forest)
        if links.parts:
            # Rows with b are links of the forest, rows without are counts.
            node, count = links.counts()
            ends = list(zip(*links.forest)) if links.forest else ((), ())
            yield pa.RecordBatch.from_arrays([
                pa.array([*node.tolist(), *ends[0]], pa.int64()), pa.array([*[None] * len(node), *ends[1]], pa.int64()),
                pa.array([*count.tolist(), *[0] * len(ends[0])], pa.int64())], names=["a", "b", "linked"])

    found = materialise(pairs.mapInArrow(compare, "a long, b long, linked long"), "embed-found")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("linked").alias("linked"))
    return counts, found.where("b is not null").select("a", "b")


def near_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id of every row."""
    given = F.col(vector)
    if table.schema[vector].dataType not in (T.ArrayType(T.FloatType(), True), T.ArrayType(T.FloatType(), False)):
        given = given.cast("array<double>")
    rows = table.select(F.col(vec_id).alias("vec_id"), given.alias("vector"), usable(vector).alias("good"))
    # Equal vectors get the same number; -0.0 and 0.0 are equal.
    plain = F.transform("vector", lambda x: x.cast("double") + F.lit(0.0))
    rows = rows.withColumn("node", F.when(F.col("good"), F.xxhash64(plain, F.size("vector"))))
    keyed = materialise(rows.select("vec_id", "node"), "embed-keys")
    good = rows.where("good").select("node", "vector")
    counts = links = None
    for size in [r["size"] for r in good.select(F.size("vector").alias("size")).distinct().collect()]:
        found = link_vectors(good.where(F.size("vector") == size), threshold)
        counts = found[0] if counts is None else counts.unionByName(found[0])
        links = found[1] if links is None else links.unionByName(found[1])
    if counts is None:
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    roots = components(links, "embed")
    distinct = keyed.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"))
    nodes = distinct.join(counts, "node", "left").join(roots, "node", "left").select(
        "node", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    nodes = materialise(nodes, "embed-nodes")
    rooted = materialise(keyed.join(nodes, "node", "left"), "embed-rooted")
    smallest = materialise(rooted.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("component_id")), "embed-smallest")
    return rooted.join(smallest, "root", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))


def op3_near_embeddings(spark, sf_dir: str) -> DataFrame:
    found = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
