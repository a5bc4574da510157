"""Near duplicates on word shingles by MinHash with tensored banding.

A text's set is its distinct 5-word shingles. Two small collections of keys
are made from its minhashes, and the key of table (i, j) combines key i of the
first collection with key j of the second: 12 + 14 keys, from 66 minhashes, give
168 tables of 5 minhashes each, where separate tables would need 840. At the
limit of 0.75 two sets meet in a table with probability 0.9995.

Documents with the same set are one class, and classes that meet are verified
on their full sets, fewest comparisons first:

1. every class against one leader that it meets: the class which meets most
   others, since the text that others were copied from is the likeliest to link;
2. the classes of buckets that hold more than one component then, by prefixes:
   a set's prefix is its rarest shingles, one more than may be missing from a
   set it links to, so linked sets share a shingle of their prefixes. Classes
   of different components that share one form a family if their bins (how many
   shingles fall in each of 256 ranges of hashes), which bound the intersection
   from above, do not exclude a link. The full sets of a family are compared
   block by block inside tasks, leaving out what is already joined.

A bucket whose classes are already linked to each other needs no more
comparisons, so the work on a large group of near copies is in proportion to
its members. Tasks return spanning forests, never the pairs they compared.
Nothing is capped: every pair of a bucket is linked through others, compared,
or excluded by a bound.

Cases: a null text or one without words has the empty set, size 0, and links
with nothing; shorter texts have their whole sequence as one shingle; equal
rows are one class; a null id never stands for a component unless all its ids
are null; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.blocks import block_pairs, with_blocks
from tidewatch.session import materialise

from .shared import WORD, components, free_name, partitions, ranges

WORDS = 5
#: Links have 100 * intersection >= 75 * union.
LIMIT = (75, 100)
#: Keys of the two collections, and minhashes per key.
FIRST, FIRST_HASHES = 12, 2
SECOND, SECOND_HASHES = 14, 3
#: Ranges of hashes that shingles are counted in, and classes per block of a shingle.
BINS = 256
BLOCK = 512
SEED = 20_011

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of MurmurHash3."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX[0]
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX[1]
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return np.empty(0, "uint64")
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "uint64", len(words))
    n = min(WORDS, len(words))
    joined = np.full(len(words) - n + 1, n, "uint64")
    for k in range(n):
        joined = mixed(joined * _STEP + hashes[k:len(words) - n + 1 + k])
    return np.unique(joined)


def minhash_keys(found: np.ndarray, odd: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The keys of both collections: each combines its own minhashes."""
    least = np.empty(len(odd), "uint64")
    for k in range(len(odd)):
        # The high bits of the product decide, and they depend on all bits of the shingle.
        least[k] = (found * odd[k] + add[k]).min()
    split = FIRST * FIRST_HASHES
    keys = []
    for part, width in ((least[:split], FIRST_HASHES), (least[split:], SECOND_HASHES)):
        part = part.reshape(-1, width)
        key = np.arange(len(part), dtype="uint64")
        for k in range(width):
            key = mixed(key * _STEP + part[:, k])
        keys.append(key)
    return np.concatenate(keys).view("int64")


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, the class of the set (two sums), and the keys (null for empty sets)."""
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("text_key", T.LongType()), T.StructField("n_shingles", T.LongType()),
        T.StructField("c1", T.LongType()), T.StructField("c2", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(SEED)
        hashes = FIRST * FIRST_HASHES + SECOND * SECOND_HASHES
        odd = rng.integers(0, 2**63, hashes, dtype="uint64") * np.uint64(2) + np.uint64(1)
        add = rng.integers(0, 2**63, hashes, dtype="uint64")
        for batch in batches:
            n, c1, c2, keys = [], [], [], []
            for value in batch.column(2):
                found = shingles(value.as_py())
                n.append(len(found))
                c1.append(int(found.sum(dtype="uint64").view("int64")))
                c2.append(int(mixed(found ^ _STEP).sum(dtype="uint64").view("int64")))
                keys.append(minhash_keys(mixed(found), odd, add) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64()))], names=[f.name for f in schema.fields])

    return docs.select("doc_id", "text_key", "text").mapInArrow(sketch, schema)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, n, members (packed sorted shingles), bins of the documents ``wanted`` (node, doc_id, text_key)."""
    kind = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.LongType()),
                         T.StructField("members", T.BinaryType()), T.StructField("bins", T.BinaryType())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = [shingles(x.as_py()) for x in batch.column(1)]
            bins = _bins(members)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in members], pa.int64()), pa.array([x.tobytes() for x in members], pa.binary()),
                 pa.array([x.tobytes() for x in bins], pa.binary())], names=[f.name for f in kind.fields])

    at = wanted.select("node", F.col("doc_id").alias("want_id"), F.col("text_key").alias("want_key"))
    # The same join at every size: the wanted rows grow with the table.
    found = docs.join(at.hint("merge"), F.expr("doc_id <=> want_id and text_key = want_key")).select("node", "text")
    return found.mapInArrow(sets, kind)


def _verified(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """The pairs a, b whose full sets reach the limit; pairs and sets are stored tables."""
    part, whole = LIMIT

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), "uint64"), np.frombuffer(y.as_py(), "uint64")
                small, large = sorted((len(x), len(y)))
                if whole * small < part * large:
                    keep.append(False)
                    continue
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(whole * both >= part * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
    two = one.join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
    return materialise(two.select("a", "b", "x", "y").mapInArrow(confirm, "a long, b long"), f"{name}-links")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Add the root of each row's node: itself if nothing links to it."""
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _open_rows(rows: DataFrame, roots: DataFrame, key: list[str], name: str) -> DataFrame:
    """The rows of those keys under which more than one component is left."""
    rooted = materialise(_rooted(rows, roots), f"{name}-rooted")
    mixed_keys = rooted.groupBy(*key).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select(*key)
    mixed_keys = materialise(mixed_keys, f"{name}-mixed")
    return materialise(rooted.join(mixed_keys, key), f"{name}-open")


def _near_sizes(one: str, other: str):
    """Sets whose sizes differ more cannot link."""
    part, whole = LIMIT
    return F.least(one, other) * whole >= F.greatest(one, other) * part


def _bins(members: list[np.ndarray]) -> np.ndarray:
    """How many shingles of each set fall in each range of hashes; a count of 255 stands for any larger one."""
    out = np.zeros((len(members), BINS), "uint8")
    for k, x in enumerate(members):
        out[k] = np.minimum(np.bincount((x >> np.uint64(56)).astype("int64"), minlength=BINS), 255)
    return out


def _may_link(bins: np.ndarray, n: np.ndarray, k: int, at: np.ndarray) -> np.ndarray:
    """Those sets ``at`` whose bins and sizes do not exclude a link with set k."""
    part, whole = LIMIT
    at = at[whole * np.minimum(n[at], n[k]) >= part * np.maximum(n[at], n[k])]
    most = np.minimum(bins[at], bins[k]).sum(1, dtype="int64")
    # A bin counts up to 255 only, so it bounds nothing for sets that may hold more.
    return at[(whole * most >= part * (n[at] + n[k] - most)) | (np.maximum(n[at], n[k]) > 255 * 16)]


def _later(block: np.ndarray, k: int) -> np.ndarray:
    """The rows that row k is compared with: those after it in a single block, else those of the other block."""
    return np.arange(len(block)) > k if block[0] == block.min() == block.max() else block > block[k]


def _families(rows: DataFrame, name: str) -> DataFrame:
    """node, family of stored ``rows`` (shingle, node, root, n, bins): sets that may link, by chains, under a shared shingle.

    Each block of a shingle returns a spanning forest, so rows come out in proportion to rows in.
    """
    sizes = materialise(rows.groupBy("shingle").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks")), f"{name}-blocks")
    dealt = rows.join(sizes, "shingle").withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))

    def chain(group: pa.Table) -> pa.Table:
        block, node, root, n = (group.column(c).to_numpy() for c in ("block", "node", "root", "n"))
        bins = np.frombuffer(b"".join(group.column("bins").to_pylist()), "uint8").reshape(-1, BINS)
        label, found = np.arange(len(node)), []
        for k in range(len(node)):
            at = np.flatnonzero(_later(block, k) & (root != root[k]) & (label != label[k]))
            for other in _may_link(bins, n, k, at):
                if label[other] != label[k]:
                    label[label == label[other]] = label[k]
                    found.append((node[k], node[other]))
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    # Copies only where a shingle has more than one block: each block meets itself and every other.
    # The work is far larger than the bytes, so the number of partitions is stated.
    met = block_pairs(dealt).repartition(partitions(rows), "shingle", "i", "j")
    chains = met.groupBy("shingle", "i", "j").applyInArrow(chain, "a long, b long")
    return components(chains, f"{name}-families").withColumnRenamed("root", "family")


def _confirmed(families: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Links a, b of a spanning forest of stored ``families`` (node, family, root), confirmed on full sets.

    A family's sets travel to the tasks that compare them, block by block, and
    only links that join two groups leave a task.
    """
    part, whole = LIMIT
    met = block_pairs(with_blocks(families, ["family"], ["node"], BLOCK)).join(sets.select("node", "members"), "node")

    def confirm(group: pa.Table) -> pa.Table:
        block, node = group.column("block").to_numpy(), group.column("node").to_numpy()
        members = [np.frombuffer(x, "uint64") for x in group.column("members").to_pylist()]
        n, bins = np.array([len(x) for x in members], "int64"), _bins(members)
        # Shingles by number, so that a set is a row of flags.
        flat = np.unique(np.concatenate(members), return_inverse=True)[1]
        start = np.cumsum(n) - n
        mine = np.zeros(flat.max() + 1, bool)
        label = np.unique(group.column("root").to_numpy(), return_inverse=True)[1]
        found = []
        for k in range(len(node)):
            at = _may_link(bins, n, k, np.flatnonzero(_later(block, k) & (label != label[k])))
            if not len(at):
                continue
            own = flat[start[k]:start[k] + n[k]]
            mine[own] = True
            both = np.add.reduceat(mine[flat[ranges(start[at], n[at])]], np.cumsum(n[at]) - n[at], dtype="int64")
            mine[own] = False
            for other in at[whole * both >= part * (n[at] + n[k] - both)]:
                if label[other] != label[k]:
                    label[label == label[other]] = label[k]
                    found.append((node[k], node[other]))
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = met.select("family", "i", "j", "block", "node", "root", "members").repartition(partitions(families), "family", "i", "j")
    return materialise(dealt.groupBy("family", "i", "j").applyInArrow(confirm, "a long, b long"), f"{name}-links")


def _stars(rows: DataFrame, order) -> DataFrame:
    """Pairs of each node and the leaders of its keys, which come first by ``order``.

    Only one leader per node, the first of all, is taken, so there are never
    more pairs than nodes.
    """
    leaders = materialise(rows.groupBy("key").agg(F.max(F.struct(order.alias("order"), "node", "root", "n")).alias("lead")), "near-leaders")
    led = rows.join(leaders, "key").where((F.col("lead.root") != F.col("root")) & _near_sizes("lead.n", "n"))
    best = led.groupBy("node").agg(F.max("lead").alias("lead"))
    return best.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()


def _prefixes(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """node, shingle: the rarest shingles of each set, one more than a linked set can lack."""
    part, whole = LIMIT
    unpacked = T.StructType([T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("shingle", T.LongType())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = [np.frombuffer(x.as_py(), "int64") for x in batch.column(1)]
            sizes = np.array([len(x) for x in members], "int64")
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(np.repeat(sizes, sizes)),
                 pa.array(np.concatenate(members) if members else np.empty(0, "int64"))], names=["node", "n", "shingle"])

    rows = sets.select("node", "members").join(nodes, "node", "left_semi")
    rows = materialise(rows.mapInArrow(unpack, unpacked), "near-unpacked")
    rare = materialise(rows.groupBy("shingle").agg(F.count("*").alias("held")), "near-held")
    order = F.row_number().over(Window.partitionBy("node").orderBy("held", "shingle"))
    # The overlap with a linked set is at least part / whole of the own set.
    return rows.join(rare, "shingle").withColumn("order", order).where(
        F.col("order") <= F.col("n") - F.ceil(F.col("n") * part / whole) + 1).select("node", "shingle")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), n_shingles, root (a number of the component; null for empty sets), component_id of every row."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
    rows = materialise(sketches(docs), "near-sketches")
    # One class per set; its node is a number made of the set, and one of its documents stands for it.
    node = F.xxhash64("c1", "c2", "n_shingles")
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    classes = rows.where("n_shingles > 0").groupBy(node.alias("node")).agg(
        F.min(one).alias("one"), F.min_by("keys", one).alias("keys"),
        F.first("n_shingles").alias("n"))
    classes = materialise(classes.select("node", "one.doc_id", "one.text_key", "n", "keys"), "near-classes")

    tables = classes.select("node", "keys", F.explode(F.sequence(F.lit(0), F.lit(FIRST * SECOND - 1))).alias("t")).select(
        "node", F.xxhash64(F.col("t"), F.expr(f"keys[t div {SECOND}]"), F.expr(f"keys[{FIRST} + t % {SECOND}]")).alias("key"))
    shared = materialise(tables.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "near-keys")
    met = materialise(tables.join(shared, "key"), "near-met")

    meets = materialise(met.groupBy("node").agg(F.sum("size").alias("meets")), "near-meets")
    wanted = materialise(meets.join(classes.drop("keys"), "node"), "near-wanted")
    sets = materialise(_sets(docs, wanted), "near-sets")
    sizes = materialise(wanted.select("node", "meets", "n"), "near-sizes")
    rest = met.select("node", "key").join(sizes, "node").withColumn("root", F.col("node"))
    rest = materialise(rest, "near-rest")

    links = _verified(materialise(_stars(rest, F.col("meets")), "near-stars"), sets, "near-star")
    roots = components(links, "near-star")
    rest = _open_rows(rest.select("node", "key"), roots, ["key"], "near-star")
    left = materialise(rest.select("node").distinct(), "near-left")
    if not left.isEmpty():
        prefixes = _open_rows(materialise(_prefixes(left, sets), "near-prefixes"), roots, ["shingle"], "near-prefix")
        prefixes = materialise(prefixes.join(sets.drop("members"), "node"), "near-binned")
        families = materialise(_rooted(_families(prefixes, "near"), roots), "near-family")
        roots = components(links.unionByName(_confirmed(families, sets, "near-rest")), "near-all")

    rooted = _rooted(rows.withColumn("node", F.when(F.col("n_shingles") > 0, node)), roots)
    rooted = materialise(rooted.select("doc_id", "text_key", "n_shingles", "root"), "near-rooted")
    smallest = materialise(rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")), "near-smallest")
    return rooted.join(smallest, "root", "left").select(
        "doc_id", "text_key", "n_shingles", "root", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their component: its smallest doc_id, null ids last, then its smallest text_key.

    Rows equal in id and text are one document, of which one row stays. Texts
    without words are nobody's duplicates, so all their rows stay.
    """
    found = materialise(near_duplicates(docs).where("root is not null"), "near-found").groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("rows"))
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "rows")
    alone = found.groupBy("root").agg(F.min(one).alias("one"))
    kept_id, kept_key = free_name(docs, "kept_id"), free_name(docs, "kept_key")
    alone = alone.select(F.col("one.doc_id").alias(kept_id), F.col("one.text_key").alias(kept_key), F.col("one.rows").alias("n_rows"))
    alone = materialise(alone, "near-kept")
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    rows = docs.where(worded).join(
        alone.drop("n_rows"), F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.xxhash64("text") == F.col(kept_key)), "left_semi")
    rows = rows if alone.where("n_rows > 1").isEmpty() else rows.dropDuplicates(["doc_id", "text"])
    return rows.unionByName(docs.where(~worded))


def op2_near_duplicates(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
