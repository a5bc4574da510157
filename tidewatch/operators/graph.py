"""User similarity graph: users are linked by the distinct features they share."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import edge_width, entropy_bits, node_size, normalised_entropy, tokens
from ..schemas import require_columns
from ..session import materialise, spread
from .blocks import block_pairs, block_triples, with_blocks

BLOCK_SIZE = 1024
FEATURE_STRIP = 4096
#: Rows of a block in clustering, whose rows are copied once per pair of blocks, and for edges, once per block; blocks that
#: a graph without keys is dealt into at least, if it fills them by ``BLOCK_SIZE``; and rows that are multiplied at once.
CLUSTER_BLOCK = 16384
EDGE_BLOCK = 8192
FEWEST_BLOCKS = 8
TILE_SIZE = 512
MISSING_TEXT = "nan"
UNKNOWN_TYPE = "unknown"
# Feature prefixes per source column.
PREFIXES = {
    "user_type": "user_type:",
    "remote_network": "remote_network:",
    "device_ip_address": "device_ip:",
}
COMMAND_PREFIX = "cmd:"


def _user_name() -> Column:
    return F.coalesce(F.col("user").cast("string"), F.lit(MISSING_TEXT))


def user_features(df: DataFrame, keys: list[str] | None = None, keep_nulls: bool = False) -> DataFrame:
    """Distinct (keys, user, feature) rows, read in one pass over the log.

    With ``keep_nulls`` a missing value is itself a shared feature.
    """
    require_columns(df, ["user", "user_type"], "similarity input")
    keys = keys or []
    single = []
    for c, prefix in PREFIXES.items():
        if c in df.columns:
            value = F.col(c).cast("string")
            value = F.coalesce(value, F.lit(MISSING_TEXT)) if keep_nulls else value
            single.append(F.concat(F.lit(prefix), value))
    features = F.array_compact(F.array(*single))
    if "cmd_keywords" in df.columns:
        words = F.transform(tokens("cmd_keywords"), lambda t: F.concat(F.lit(COMMAND_PREFIX), t))
        features = F.concat(features, words)
    return df.select(*keys, _user_name().alias("user"), F.explode(features).alias("feature")).distinct()


def last_type(df: DataFrame, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """One type per user: that of the last row in ``order``, ``unknown`` if missing."""
    keys = keys or []
    return df.groupBy(*keys, _user_name().alias("user")).agg(
        F.coalesce(F.max_by("user_type", F.struct(*order)), F.lit(UNKNOWN_TYPE)).alias("user_type")
    )


def feature_sets(uf: DataFrame, keys: list[str]) -> DataFrame:
    """Each user's features as one sorted array."""
    return uf.groupBy(*keys, "user").agg(F.array_sort(F.collect_set("feature")).alias("features"))


Blocks = dict[int, np.ndarray]


class Tile(NamedTuple):
    """Some rows of a task: their places, and the owner and number of each feature."""

    rows: np.ndarray
    owner: np.ndarray
    codes: np.ndarray
    known: np.ndarray


def _key_fields(df: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def projected_edges(
    uf: DataFrame, keys: list[str] | None = None, block_size: int | None = None, among: DataFrame | None = None
) -> DataFrame:
    """Edges (src < dst) weighted by the number of shared features; ``among`` (column user) leaves other users unpaired.

    Two blocks of users meet in one task, which counts shared features as matrix
    products of tiles and returns only linked pairs; each pair arises once, not
    once per shared feature. A task returns one row per user and tile, with all
    linked users of the tile behind its name; Spark makes rows of the pairs. A user
    is copied once per block, so blocks are large and few.
    """
    keys = keys or []
    if among is not None:
        uf = uf.join(among.select("user"), "user", "left_semi")
    users = feature_sets(uf, keys)
    pairs = block_pairs(_few_blocks(users, keys, ["user"], EDGE_BLOCK, block_size))
    schema = T.StructType([
        *_key_fields(users, keys), T.StructField("src", T.StringType()),
        T.StructField("linked", T.ArrayType(T.StringType())), T.StructField("weights", T.ArrayType(T.IntegerType())),
    ])
    arrow = to_arrow_schema(schema)

    def edges(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = (k.as_py() for k in key[-2:])
        table = pa.Table.from_batches(batches)
        names, blocks = table["user"].combine_chunks(), table["block"].to_numpy()
        place = np.empty(len(names), np.int64)
        place[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        tiles = _tiles(table["features"], {b: np.flatnonzero(blocks == b) for b in {i, j}})
        for k, one in enumerate(tiles[i]):
            for other in tiles[j][k:] if i == j else tiles[j]:
                weights = _common(one, other).astype(np.int32)
                ordered = place[one.rows][:, None] < place[other.rows]
                ways = [(one, other, weights * ordered)]
                if one is not other:
                    ways.append((other, one, (weights * ~ordered).T))
                for src, dst, part in ways:
                    a, b = np.nonzero(part)
                    ends = pa.array(np.searchsorted(a, np.arange(len(src.rows) + 1)).astype(np.int32))
                    columns = [*(pa.array([k.as_py()] * len(src.rows)) for k in key[:-2]), names.take(pa.array(src.rows)),
                               pa.ListArray.from_arrays(ends, names.take(pa.array(dst.rows[b]))),
                               pa.ListArray.from_arrays(ends, pa.array(part[a, b]))]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    found = spread(pairs, *keys, "i", "j").groupBy(*keys, "i", "j").applyInArrow(edges, schema)
    weight = F.get("weights", "place").cast("long").alias("weight")
    return found.select(*keys, "src", F.posexplode("linked").alias("place", "dst"), "weights").select(*keys, "src", "dst", weight)


def neighbor_types(uf: DataFrame, types: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Edge weight of each user towards each neighbour type, without any pairs.

    The weight is, summed over the user's features, the number of other users
    of that type holding the feature.
    """
    keys = keys or []
    typed = uf.join(types, [*keys, "user"])
    holders = typed.groupBy(*keys, "feature", F.col("user_type").alias("neighbor_type")).agg(
        F.count("*").alias("holders")
    )
    others = F.col("holders") - (F.col("user_type") == F.col("neighbor_type")).cast("long")
    return (
        typed.join(holders, [*keys, "feature"])
        .groupBy(*keys, "user", "neighbor_type").agg(F.sum(others).alias("weight"))
        .where(F.col("weight") > 0)
    )


def weighted_degree(uf: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sum of a user's edge weights: other holders of each of its features."""
    keys = keys or []
    holders = uf.groupBy(*keys, "feature").agg(F.count("*").alias("holders"))
    return uf.join(holders, [*keys, "feature"]).groupBy(*keys, "user").agg(
        F.sum(F.col("holders") - 1).alias("degree")
    )


def neighbor_type_entropy(uf: DataFrame, types: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Degree and entropy of neighbour types per user that has neighbours."""
    keys = keys or []
    return neighbor_types(uf, types, keys).groupBy(*keys, "user").agg(
        F.sum("weight").alias("degree"),
        entropy_bits("weight").alias("neighbor_type_entropy"),
        normalised_entropy("weight").alias("neighbor_type_entropy_norm"),
    )


def weighted_clustering(uf: DataFrame, keys: list[str] | None = None, block_size: int | None = None) -> DataFrame:
    """Weighted clustering coefficient per user.

    Mean over neighbour pairs of the cube root of the three edge weights, each
    divided by the largest weight in the graph.

    Users with equal features are interchangeable, so the sums run over
    distinct feature sets with their number of members. Blocks of sets meet
    three at a time; triangles are summed by matrix products of tiles, never listed.
    A set is copied once per pair of blocks, so blocks are large and few.
    """
    keys = keys or []
    return _clustering(materialise(feature_sets(uf, keys), "feature-sets"), keys, block_size)


def _tiles(features: pa.ChunkedArray, rows_of: Blocks) -> dict[int, list[Tile]]:
    """The rows of each block in tiles; features are numbered within the task."""
    lists = features.combine_chunks()
    length = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    codes = lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    start = np.cumsum(length) - length

    def tile(rows: np.ndarray) -> Tile:
        n = length[rows]
        owner = np.repeat(np.arange(len(rows)), n)
        at = np.arange(len(owner)) + np.repeat(start[rows] - (np.cumsum(n) - n), n)
        return Tile(rows, owner, codes[at], np.unique(codes[at]))

    return {b: [tile(rows[k:k + TILE_SIZE]) for k in range(0, len(rows), TILE_SIZE)] for b, rows in rows_of.items()}


def _common(one: Tile, other: Tile) -> np.ndarray:
    """Common features of the rows of two tiles, of two different rows each: 0 for a row and itself."""
    both = np.intersect1d(one.known, other.known, assume_unique=True)
    out = np.zeros((len(one.rows), len(other.rows)), dtype=np.float32)
    for k in range(0, len(both), FEATURE_STRIP):
        strip = both[k:k + FEATURE_STRIP]
        held = []
        for tile in {id(one): one, id(other): other}.values():
            at = np.minimum(np.searchsorted(strip, tile.codes), len(strip) - 1)
            inside = strip[at] == tile.codes
            matrix = np.zeros((len(tile.rows), len(strip)), dtype=np.float32)
            matrix[tile.owner[inside], at[inside]] = 1.0
            held.append(matrix)
        out += held[0] @ held[-1].T
    if one is other:
        np.fill_diagonal(out, 0.0)
    return out


def _cluster_blocks(classes: DataFrame, keys: list[str], block_size: int | None) -> DataFrame:
    return _few_blocks(classes, keys, ["features"], CLUSTER_BLOCK, block_size)


def _few_blocks(df: DataFrame, keys: list[str], identity: list[str], size: int, block_size: int | None) -> DataFrame:
    """Blocks of ``block_size``; without it, few large ones of ``size``, since each row is copied once per block or pair of blocks."""
    if block_size is not None:
        return with_blocks(df, keys, identity, block_size)
    return with_blocks(df, keys, identity, size, 1 if keys else FEWEST_BLOCKS, BLOCK_SIZE)


def _clustering(users: DataFrame, keys: list[str], block_size: int | None) -> DataFrame:
    classes = users.groupBy(*keys, "features").agg(F.count("*").cast("double").alias("members"))
    # The sums below travel under a number instead of the features; written once, so numbers stay.
    classes = materialise(classes.withColumn("class", F.monotonically_increasing_id()), "feature-classes")
    triples = block_triples(_cluster_blocks(classes, keys, block_size))

    def triangles(key: tuple, table: pa.Table) -> pa.Table:
        triple = [k.as_py() for k in key[-3:]]
        blocks = table["block"].to_numpy()
        members = table["members"].to_numpy()
        tiles = _tiles(table["features"], {b: np.flatnonzero(blocks == b) for b in set(triple)})
        own = pc.list_value_length(table["features"]).to_numpy().astype(np.float64)
        root_own = np.cbrt(own)
        roots = np.cbrt(np.arange(int(own.max(initial=0)) + 1, dtype=np.float64))
        total, neighbors, heaviest = (np.zeros(len(blocks)) for _ in range(3))

        def root(one: Tile, other: Tile) -> np.ndarray:
            return roots[_common(one, other).astype(np.intp)]

        for p in set(triple):
            # The corner's block and those of the other two; exchanging these gives the same sum.
            q, r = (b for k, b in enumerate(triple) if k != triple.index(p))
            for tile in tiles[p]:
                a = tile.rows
                near = {id(t): root(tile, t) for b in {q, r} for t in tiles[b]}
                for k, end in enumerate(tiles[r]):
                    c = end.rows
                    ended = near[id(end)] * members[c]
                    for m, middle in enumerate(tiles[q][:k + 1] if q == r else tiles[q]):
                        walks = (near[id(middle)] * members[middle.rows]) @ root(middle, end)
                        times = 1 if q == r and m == k else 2
                        total[a] += times * np.einsum("ij,ij->i", walks, ended)
                if q != r:
                    continue
                # Triangles with two corners in one feature set; each ordered pair of
                # blocks passes here once.
                for other in tiles[q]:
                    b = other.rows
                    squared = near[id(other)] ** 2
                    shared = _common(tile, other)
                    total[a] += 2 * (members[a] - 1) * root_own[a] * (squared @ members[b])
                    total[a] += squared @ (members[b] * (members[b] - 1) * root_own[b])
                    neighbors[a] += (shared > 0) @ members[b]
                    heaviest[a] = np.maximum(heaviest[a], shared.max(axis=1, initial=0.0))
                if p == q:
                    total[a] += (members[a] - 1) * (members[a] - 2) * own[a]
                    neighbors[a] += members[a] - 1
                    heaviest[a] = np.maximum(heaviest[a], np.where(members[a] > 1, own[a], 0.0))
        kept = table.select(["class"])
        for name, values in (("total", total), ("neighbors", neighbors), ("heaviest", heaviest)):
            kept = kept.append_column(name, pa.array(values))
        return kept

    schema = T.StructType([
        T.StructField("class", T.LongType()), T.StructField("total", T.DoubleType()),
        T.StructField("neighbors", T.DoubleType()), T.StructField("heaviest", T.DoubleType()),
    ])
    partial = spread(triples, *keys, "i", "j", "k").groupBy(*keys, "i", "j", "k").applyInArrow(triangles, schema)
    summed = partial.groupBy("class").agg(
        F.sum("total").alias("total"), F.sum("neighbors").alias("neighbors"), F.max("heaviest").alias("heaviest"))
    # Used twice below and costly, so it is written once.
    per_class = materialise(classes.select(*keys, "features", "class").join(summed, "class").drop("class"), "triangles")
    measured = users.join(per_class, [*keys, "features"])
    if keys:
        top = per_class.groupBy(*keys).agg(F.max("heaviest").alias("top"))
        measured = measured.join(top, keys)
    else:
        measured = measured.withColumn("top", per_class.agg(F.max("heaviest").alias("top")).scalar())
    pairs = F.col("neighbors") * (F.col("neighbors") - 1)
    value = F.when(pairs > 0, F.col("total") / F.col("top") / pairs).otherwise(F.lit(0.0))
    return measured.select(*keys, "user", value.alias("clustering"))


def graph_features(
    df: DataFrame, order: list[str], keys: list[str] | None = None, block_size: int | None = None
) -> DataFrame:
    """Degree, clustering, neighbour-type entropies and type per user (and key).

    Users are those with at least one feature.
    """
    keys = keys or []
    users = materialise(feature_sets(user_features(df, keys), keys), "feature-sets")
    uf = users.select(*keys, "user", F.explode("features").alias("feature"))
    types = last_type(df, order, keys)
    on = [*keys, "user"]
    zero = F.lit(0.0)
    return (
        users.select(*on).join(types, on).join(neighbor_type_entropy(uf, types, keys), on, "left")
        .join(_clustering(users, keys, block_size), on, "left")
        .select(
            *on, F.coalesce(F.col("degree").cast("double"), zero).alias("degree"),
            F.coalesce("clustering", zero).alias("clustering"),
            F.coalesce("neighbor_type_entropy", zero).alias("neighbor_type_entropy"),
            F.coalesce("neighbor_type_entropy_norm", zero).alias("neighbor_type_entropy_norm"),
            "user_type",
        )
    )


def daily_graph_features(df: DataFrame, order: list[str], block_size: int | None = None) -> DataFrame:
    """Graph measures per user and ``event_date``, named as the access pipelines take them."""
    features = graph_features(df, order, ["event_date"], block_size)
    return features.select(
        "user", "event_date", F.col("neighbor_type_entropy_norm").alias("entropy"), "degree",
        F.col("clustering").alias("clustering_coefficient"),
    )


def threshold_edges(edges: DataFrame, min_weight: int = 1) -> DataFrame:
    """Drop edges below ``min_weight``; 1 keeps all."""
    return edges.where(F.col("weight") >= min_weight) if min_weight > 1 else edges


def induced_subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (column user)."""
    ids, kept = nodes.select("user"), edges
    for end in ("src", "dst"):
        kept = kept.join(ids.withColumnRenamed("user", end), end, "left_semi")
    return kept.select(*edges.columns)


def top_nodes(degrees: DataFrame, n: int = 150) -> DataFrame:
    return degrees.orderBy(F.desc("degree"), "user").limit(n)


def graph_sample(
    df: DataFrame, order: list[str], n: int = 150, min_weight: int = 1, n_labels: int = 20
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the densest ``n`` users, with drawing sizes.

    Users are chosen by degree, which needs no edges; only the chosen users'
    features are then paired.
    """
    uf = user_features(df, keep_nulls=True)
    chosen = top_nodes(weighted_degree(uf), n)
    labelled = top_nodes(chosen, n_labels).select("user", F.lit(True).alias("labelled"))
    types = last_type(df, order)
    nodes = (
        chosen.join(labelled, "user", "left").join(types, "user", "left")
        .select(
            "user", "degree", "user_type", node_size("degree").alias("size"),
            F.coalesce("labelled", F.lit(False)).alias("labelled"),
        )
    )
    edges = threshold_edges(projected_edges(uf, among=chosen), min_weight)
    return nodes, edges.withColumn("width", edge_width("weight"))
