"""Merkle manifest of a dataset by time-forward processing.

Leaves are ranked within their tree (one per source) by a range partitioning,
and a node's label is (level, place). Digests travel as messages to the label
of their parent: inside a task a priority queue ordered by label hands them
out, and what leaves a task is sorted to the next one by Spark's shuffle, so
the queue of all messages is external and in label order. One round lifts
blocks of ``ARITY ** HEIGHT`` neighbours to one node each, until every tree
has one node; the subroots then are leaves of the tree of sources.

The reversed sweep goes from the root to the leaves: each node gets its path
(per level the digests of its run and its own place in it), adds its own
run in front, and hands that on. A leaf turns its path into the digest of its
proof, and folds its tampered text's leaf up to the root. A task handles whole
blocks, so no list of a tree's nodes is ever gathered, and only digests, never
texts, are shuffled.

Cases: null values have their own mark; null ids come first; rows equal in all
fields are neighbours with proofs of their own; a null id is never tampered with;
an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import materialise

from .shared import crc32_sql, crc32_table_sql, partitions

ARITY = 16
#: Levels that a round lifts: blocks of 256 nodes are one task's smallest unit.
HEIGHT = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows whose CRC-32 of the id this divides are tampered with.
TAMPERED = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(docs: DataFrame, text: Column) -> Column:
    values = [encoded(docs[c]) for c in FIELDS if c != "text"] + [encoded(text)]
    return F.sha2(F.concat(*values), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree (the source), digest, row, and the digest after tampering where that happens, stored."""
    hit = F.pmod(F.crc32(docs["doc_id"].cast("string")), F.lit(TAMPERED)) == 0
    other = F.when(hit, leaf(docs, F.translate(docs["text"], _UPPER, _LOWER)))
    return materialise(docs.select(
        docs["doc_id"], docs["source"].cast("string").alias("tree"), leaf(docs, docs["text"]).alias("digest"), other.alias("tampered"),
        F.monotonically_increasing_id().alias("row")), "merkle-leaves")


def ranked(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """Add ``place``, from 0, of each row among those of its ``tree``, and ``n``, how many it has; rows are stored and differ in ``order``.

    Rows are partitioned by ranges of (tree, order); a row's place is its place
    in its range, after the counted rows of the ranges before.
    """
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    dealt = rows.repartitionByRange(partitions(rows), *keys).withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt, f"{name}-dealt")
    before = Window.partitionBy("tree_key").orderBy("part")
    counts = dealt.groupBy(F.col(tree).alias("tree_key"), "part").agg(F.count("*").alias("rows"))
    counts = counts.select(
        F.col("tree_key"), F.col("part").alias("part_key"), F.sum("rows").over(Window.partitionBy("tree_key")).alias("n"),
        F.coalesce(F.sum("rows").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    counts = materialise(counts, f"{name}-counts")
    within = F.row_number().over(Window.partitionBy("part", tree).orderBy(*keys[1:])) - 1
    joined = dealt.withColumn("within", within).join(counts, F.expr(f"{tree} <=> tree_key and part = part_key"))
    return joined.select(*rows.columns, (F.col("before") + F.col("within")).alias("place"), F.col("n").cast("long").alias("n"))


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def lift(block: list[str], levels: int, arity: int = ARITY) -> list[list[str]]:
    """Digests of the block's nodes by level, its own first, by time-forward processing.

    Messages (level, place of the parent, place of the child, digest) wait in a
    priority queue; all messages of one parent come out together and become
    its digest, which is sent on.
    """
    found = [block] + [[] for _ in range(levels)]
    if not levels:
        return found
    queue = [(1, at // arity, at, x) for at, x in enumerate(block)]  # in order, which is a heap
    while queue:
        level, place = queue[0][:2]
        run = []
        while queue and queue[0][:2] == (level, place):
            run.append(heapq.heappop(queue)[3])
        found[level].append(digest(run))
        if level < levels:
            heapq.heappush(queue, (level + 1, place // arity, place, found[level][-1]))
    return found


def levels_of(n: int, height: int = HEIGHT, arity: int = ARITY) -> int:
    """Levels that a round lifts in a tree of ``n`` nodes."""
    levels = 0
    while n > 1 and levels < height:
        n, levels = -(-n // arity), levels + 1
    return levels


def blocks(rows: DataFrame) -> DataFrame:
    """Rows (tree, place, ...) dealt to tasks by block, in label order."""
    rows = rows.withColumn("block", F.expr(f"place div {ARITY ** HEIGHT}"))
    return rows.repartition(partitions(rows), "tree", "block").sortWithinPartitions("tree", "block", "place")


def by_block(batches: Iterator[pa.RecordBatch], work: Callable[[list[dict]], Iterator[dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows that ``work`` makes of one block after the other."""
    def finished() -> Iterator[dict]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["block"] != held[0]["block"] or row["tree"] != held[0]["tree"]):
                    yield from work(held)
                    held = []
                held.append(row)
        if held:
            yield from work(held)

    rows = finished()
    while some := list(islice(rows, 2048)):
        yield pa.RecordBatch.from_pylist(some, schema)


#: Per level a node's place in its run and the digests of the run.
PATH = "array<struct<at:int,run:array<string>>>"
_PATH = pa.list_(pa.struct([("at", pa.int32()), ("run", pa.list_(pa.string()))]))


def raised(nodes: DataFrame) -> DataFrame:
    """tree, place, n, digest of the nodes that the blocks of ``nodes`` become."""
    schema = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])

    def work(block: list[dict]) -> Iterator[dict]:
        n, levels = block[0]["n"], levels_of(block[0]["n"])
        top = lift([r["digest"] for r in block], levels)[-1][0]
        yield {"tree": block[0]["tree"], "place": block[0]["block"], "n": -(-n // ARITY ** levels), "digest": top}

    return blocks(nodes.select("tree", "place", "n", "digest")).mapInArrow(
        lambda batches: by_block(batches, work, schema), "tree string, place long, n long, digest string")


def _with_path(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``nodes`` in blocks; the path of the node that a block became, and its tree's last digest, stand in the block's first row only."""
    above = above.select(F.col("tree").alias("above"), F.col("place").alias("above_place"), "path", "last")
    first = (F.expr(f"place % {ARITY ** HEIGHT}") == 0) & F.col("tree").eqNullSafe(F.col("above")) & (
        F.expr(f"place div {ARITY ** HEIGHT}") == F.col("above_place"))
    return blocks(nodes.join(above, first, "left").drop("above", "above_place"))


def own_path(found: list[list[str]], at: int) -> list[dict]:
    """The path of leaf ``at`` inside its block, whose digests by level are ``found``."""
    path = []
    for level in range(len(found) - 1):
        place = at // ARITY ** level
        start = place - place % ARITY
        path.append({"at": place - start, "run": found[level][start:start + ARITY]})
    return path


def lowered(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """tree, place, path, last of ``nodes``, from those of the nodes that their blocks became."""
    schema = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("path", _PATH), ("last", pa.string())])

    def work(block: list[dict]) -> Iterator[dict]:
        found = lift([r["digest"] for r in block], levels_of(block[0]["n"]))
        for at, row in enumerate(block):
            yield {"tree": row["tree"], "place": row["place"], "path": own_path(found, at) + block[0]["path"], "last": block[0]["last"]}

    return _with_path(nodes.select("tree", "place", "n", "digest"), above).mapInArrow(
        lambda batches: by_block(batches, work, schema), f"tree string, place long, path {PATH}, last string")


def climb(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Stored rounds of nodes (tree, place, n, digest): the given ones first, one node per tree last."""
    rounds = [materialise(nodes, f"{name}-0")]
    while not rounds[-1].where("n > 1").isEmpty():
        rounds.append(materialise(raised(rounds[-1]), f"{name}-{len(rounds)}"))
    return rounds


def folded(start: str, path: list[dict]) -> str:
    """The digest at the end of ``path`` if it begins with ``start``."""
    for step in path:
        start = digest([*step["run"][:step["at"]], start, *step["run"][step["at"] + 1:]])
    return start


def proof(path: list[dict]) -> str:
    """The siblings along ``path``, from left to right, level by level, as one text."""
    return "".join(x for step in path for at, x in enumerate(step["run"]) if at != step["at"])


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    rows = ranked(leaves(docs), "tree", ["doc_id", "digest", "row"], "merkle")
    rows = materialise(rows.drop("row"), "merkle-ranked")
    trees = climb(rows.select("tree", "place", "n", "digest"), "merkle-up")
    # The subroots are the leaves of the tree of sources.
    subroots = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    subroots = materialise(ranked(materialise(subroots, "merkle-subroots"), "tree", ["source"], "merkle-sources"), "merkle-sources")
    tops = climb(subroots.select("tree", "place", "n", "digest"), "merkle-top")
    above = tops[-1].select("tree", "place", F.array().cast(PATH).alias("path"), F.col("digest").alias("last"))
    for nodes in reversed(tops[:-1]):
        above = materialise(lowered(nodes, above), "merkle-down")
    # The path of a subroot is that of its tree's last node; "last" is the root in both.
    above = subroots.join(above.drop("tree"), "place").select(
        F.col("source").alias("tree"), F.lit(0).cast("long").alias("place"),
        F.struct("path", "last", F.col("digest").alias("subroot")).alias("found"))
    above = above.select("tree", "place", "found.path", F.concat("found.subroot", F.lit(" "), "found.last").alias("last"))
    for nodes in reversed(trees[1:-1]):
        above = materialise(lowered(nodes, above), "merkle-down")

    kind = rows.schema["doc_id"].dataType
    out = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, T.StringType()) for c in (
        "leaf", "subroot", "root", "proof_sha256", "folded_root")), T.StructField("verified", T.BooleanType())])

    def work(block: list[dict]) -> Iterator[dict]:
        found = lift([r["digest"] for r in block], levels_of(block[0]["n"]))
        rest, (subroot, root) = block[0]["path"], block[0]["last"].split(" ")
        suffix = proof(rest)
        for at, row in enumerate(block):
            own = own_path(found, at)
            end = folded(folded(row["tampered"] or row["digest"], own), rest)
            yield {"doc_id": row["doc_id"], "leaf": row["digest"], "subroot": subroot, "root": root,
                   "proof_sha256": digest([proof(own), suffix]), "folded_root": end, "verified": end == root}

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([first.schema.field("doc_id"), *((f.name, pa.string()) for f in out.fields[1:-1]), ("verified", pa.bool_())])
        yield from by_block(chain([first], batches), work, schema)

    return _with_path(rows, above).mapInArrow(finish, out)


def op13_manifest(spark, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _field_sql(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen(CAST({column} AS VARCHAR)) || ':' || {column} END"


_LEAF_SQL = " || ".join(_field_sql(c) for c in FIELDS)
OP13_SQL = f"""
WITH RECURSIVE {crc32_table_sql()},
rows AS (SELECT *, row_number() OVER () AS nr, sha256({_LEAF_SQL}) AS leaf,
    CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % {TAMPERED} = 0
      THEN sha256({" || ".join(_field_sql(c) for c in FIELDS[:-1])} || {_field_sql("translate(text, '" + _UPPER + "', '" + _LOWER + "')")}) END AS other
  FROM documents, crc_table),
placed AS (SELECT nr, doc_id, source, leaf, coalesce(other, leaf) AS other,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM rows),
trees(level, tree, place, digest, n) AS (
  SELECT 0, source, place, leaf, count(*) OVER (PARTITION BY source) FROM placed
  UNION ALL
  SELECT level + 1, tree, place // {ARITY}, sha256(string_agg(digest, '' ORDER BY place)), (n + {ARITY - 1}) // {ARITY}
  FROM trees WHERE n > 1 GROUP BY level, tree, n, place // {ARITY}),
subroots AS (SELECT tree, level AS height, digest, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place, count(*) OVER () AS n
  FROM trees WHERE n = 1),
tops(level, place, digest, n) AS (
  SELECT 0, place, digest, n FROM subroots
  UNION ALL
  SELECT level + 1, place // {ARITY}, sha256(string_agg(digest, '' ORDER BY place)), (n + {ARITY - 1}) // {ARITY}
  FROM tops WHERE n > 1 GROUP BY level, n, place // {ARITY}),
runs AS (
  SELECT level, tree, place // {ARITY} AS run, list(digest ORDER BY place) AS members FROM trees WHERE n > 1 GROUP BY ALL),
top_runs AS (SELECT level, place // {ARITY} AS run, list(digest ORDER BY place) AS members FROM tops WHERE n > 1 GROUP BY ALL),
-- A leaf climbs its own tree, then the tree of sources.
climbs(nr, tree, level, place, proof, digest) AS (
  SELECT nr, source, 0, place, '', other FROM placed
  UNION ALL
  SELECT nr, c.tree, c.level + 1, c.place // {ARITY},
    proof || array_to_string(members[:c.place % {ARITY}] || members[c.place % {ARITY} + 2:], ''),
    sha256(array_to_string(members[:c.place % {ARITY}] || [c.digest] || members[c.place % {ARITY} + 2:], ''))
  FROM climbs c JOIN runs r ON r.level = c.level AND r.tree IS NOT DISTINCT FROM c.tree AND r.run = c.place // {ARITY}),
arrived AS (SELECT c.nr, s.place, c.proof, c.digest FROM climbs c JOIN subroots s ON s.tree IS NOT DISTINCT FROM c.tree AND s.height = c.level),
tops_climbed(nr, level, place, proof, digest) AS (
  SELECT nr, 0, place, proof, digest FROM arrived
  UNION ALL
  SELECT nr, c.level + 1, c.place // {ARITY},
    proof || array_to_string(members[:c.place % {ARITY}] || members[c.place % {ARITY} + 2:], ''),
    sha256(array_to_string(members[:c.place % {ARITY}] || [c.digest] || members[c.place % {ARITY} + 2:], ''))
  FROM tops_climbed c JOIN top_runs r ON r.level = c.level AND r.run = c.place // {ARITY})
SELECT p.doc_id, p.leaf, s.digest AS subroot, t.digest AS root, sha256(c.proof) AS proof_sha256, c.digest AS folded_root,
  c.digest = t.digest AS verified
FROM placed p JOIN subroots s ON s.tree IS NOT DISTINCT FROM p.source JOIN tops t ON t.n = 1
JOIN tops_climbed c ON c.nr = p.nr AND c.level = t.level
"""
