"""Near duplicates of texts and of vectors, toxicity and the pipeline, against brute force."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF
from tidewatch.llm import embeddings, minhash, mixing, packing, shared, toxicity

DOCS = "doc_id long, text string, root string, n int"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def sets_of(rows):
    out = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
        out[i] = frozenset(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
    return out


def brute_near(rows):
    sets = sets_of(rows)
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, brute_components(ids, links)


def edited(rng, words, n):
    words = list(words)
    for at in rng.choice(len(words), n, replace=False):
        words[at] = f"w{rng.integers(10**9)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies():
    rng = np.random.default_rng(1)
    rows, i = [], 0
    for group in range(6):
        base = [f"b{group}x{k}" for k in range(rng.integers(20, 150))]
        for _ in range(40 if group == 0 else 5):
            rows.append((i, edited(rng, base, min(len(base) // 3, int(rng.integers(0, 6)))), "x", 1))
            i += 1
    odd = [None, "", " \t ", "One two", "one TWO", "one  two\n", "É a b c d", "é a b c d", "solo", "x " * 4000, "x " * 5000]
    return rows + [(i + k, t, None, None) for k, t in enumerate(odd)]


def test_near_duplicates_equal_brute_force(spark, copies):
    docs = spark.createDataFrame(copies, DOCS).unionByName(
        spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 100_000).alias("doc_id"), "text"), allowMissingColumns=True)
    sets, want = brute_near([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}


def test_large_group_is_compared_in_blocks(spark, monkeypatch, copies):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    docs = spark.createDataFrame(copies, DOCS)
    _, want = brute_near([(r[0], r[1]) for r in copies])
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()} == want


def test_one_of_each_group_stays(spark, copies):
    docs = spark.createDataFrame([*copies, copies[3], copies[3], (None, copies[3][1], "x", 2)], DOCS)
    _, want = brute_near([(r[0], r[1]) for r in copies])
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, root in want.items() if i == root)


def test_different_texts_under_null_or_repeated_ids_stay(spark):
    texts = [(None, "one two three"), (None, "four five six"), (None, "a b c d e f g"), (None, "t u v w x y z"), (1, "red green"), (1, "blue black"),
             (2, None), (2, ""), (None, None), (None, " "), (None, "one TWO three"), (1, "red  green")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], DOCS)
    kept = [(r["doc_id"], " ".join((r["text"] or "").lower().split())) for r in minhash.keep_one(docs).collect()]
    want = [(None, "one two three"), (None, "four five six"), (None, "a b c d e f g"), (None, "t u v w x y z"), (1, "red green"), (1, "blue black"),
            (2, ""), (2, ""), (None, ""), (None, "")]
    assert sorted(kept, key=repr) == sorted(want, key=repr)


def test_bins_bound_intersections():
    rng = np.random.default_rng(2)
    for _ in range(50):
        pool = rng.integers(0, 2**64, 300, dtype="uint64")
        a, b = (np.unique(rng.choice(pool, 120)) for _ in range(2))
        bins = [np.bincount((x >> np.uint64(56)).astype("int64"), minlength=256) for x in (a, b)]
        assert np.minimum(*bins).sum() >= len(np.intersect1d(a, b))


def test_components_of_chains_stars_and_rings(spark):
    links = [(k, k + 1) for k in range(1, 60)] + [(100, 200 + k) for k in range(30)] + [(500, 501), (501, 502), (502, 500), (7, 7)]
    got = {r["node"]: r["root"] for r in shared.components(spark.createDataFrame(links, "a long, b long"), "test").collect()}
    ids = {x for a, b in links if a != b for x in (a, b)}
    assert got == brute_components(sorted(ids), [(a, b) for a, b in links if a != b])


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert minhash.near_duplicates(none).count() == 0 and minhash.keep_one(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.keep_clean(none, labels).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_vectors(vectors).count() == 0


def brute_vectors(rows):
    good = {i: np.array(v, "float64") for i, v in rows if v and None not in v and np.isfinite(np.array(v, "float64")).all() and any(v)}
    links = []
    for k, a in enumerate(sorted(good)):
        for b in sorted(good)[:k]:
            x, y = good[a], good[b]
            if len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.95:
                links.append((a, b))
    count = {i: 0 for i, _ in rows}
    for pair in links:
        for i in pair:
            count[i] += 1
    return count, brute_components(sorted(count), links)


@pytest.mark.parametrize("block, tile", [(2048, 1024), (16, 5)])
def test_vectors_equal_brute_force(spark, monkeypatch, block, tile):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "TILE", tile)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 20))
    rows = [(k, (centres[k % 12] + rng.normal(size=20) * 0.24).tolist()) for k in range(150)]
    rows += [(200, None), (201, []), (202, [0.0] * 20), (203, [1.0, None] * 10), (204, [float("nan")] * 20), (205, [float("inf")] * 20),
             (206, rows[3][1]), (207, rows[3][1]), (208, [x * 7 for x in rows[3][1]]), (209, [1.0, 2.0]), (210, [2.0, 4.0]), (211, [1e-30] * 20)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit("clash"))
    count, root = brute_vectors(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(docs).collect()}
    assert got == {i: (count[i], root[i]) for i in count}


def test_vectors_are_stored_once_whatever_the_pairs_of_blocks(spark, monkeypatch):
    """Blocks meet in a cartesian product of their files: no pair's copy of a vector is shuffled, and one table holds vectors."""
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    stored, write = {}, embeddings.materialise

    def kept(df, name):
        stored[name] = (df._jdf.queryExecution().executedPlan().toString(), write(df, name))
        return stored[name][1]

    monkeypatch.setattr(embeddings, "materialise", kept)
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=12).tolist()) for k in range(300)] + [(300, None)]
    rows += [(400 + k, rows[k][1]) for k in range(40)]
    found = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert found.count() == 341 and found.where("n_links > 0").count() == 80
    plan = stored["embed-found"][0]
    assert "CartesianProduct" in plan and "Exchange" not in plan
    assert [n for n, (_, df) in stored.items() if {"vector", "turned"} & {*df.columns}] == ["embed-blocks"]
    blocks = stored["embed-blocks"][1].collect()
    nodes = [x for r in blocks for x in np.frombuffer(r["node"], "int64").tolist()]
    assert len(nodes) == len({*nodes}) == 300 and len(blocks) >= 19
    for r in blocks:
        n = len(r["node"]) // 8
        assert n <= 16 and len(r["vector"]) == 4 * 12 * n and len(r["copies"]) == 8 * n


def test_vectors_of_the_table_equal_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    count, root = brute_vectors([(r["vec_id"], r["embedding"]) for r in table.collect()])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(table).collect()}
    assert got == {i: (count[i], root[i]) for i in count}


def labelled(spark):
    rng = np.random.default_rng(4)
    words = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(1500):
        text = list(rng.choice(words, 40))
        insult, group = rng.random() < 0.3, rng.random() < 0.3
        text += ["rotter"] * insult + ["islander"] * group
        rows.append((i, " ".join(text), "r", 1))
        labels.append((i, 0, int(insult and group)))
    docs = spark.createDataFrame([*rows, (None, None, None, None), (9001, "", None, None), (9001, "", None, None)], DOCS)
    return docs, spark.createDataFrame([*labels, (None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")


def test_toxicity_learns_what_only_pairs_of_words_mark(spark):
    docs, labels = labelled(spark)
    scored = toxicity.fit(docs, labels).score(docs)
    assert scored.columns == [*docs.columns, "score"] and scored.count() == docs.count()
    held = scored.where(toxicity.fold("doc_id") == 0).join(labels, "doc_id").where("toxic is not null").collect()
    right = sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in held)
    assert len(held) > 200 and right >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in scored.collect())
    assert {r["score"] < 0.5 for r in scored.where("text is null or text = ''").collect()} == {True}


@pytest.mark.parametrize("n", [20, 32])
def test_few_labels_are_enough_for_clear_words(spark, n):
    rows = [(i, f"the same words and number {i} " + ("blorp zint quag" if i % 2 else "plain"), "r", 1) for i in range(3 * n)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(n)], "doc_id long, quality int, toxic int")
    scored = toxicity.fit(docs, labels).score(docs).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in scored)


def test_words_that_mark_only_together_are_learned(spark):
    """Each of two words is as frequent in toxic texts as in others; toxic are those with one of them but not both."""
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(1600):
        one, two = rng.random() < 0.5, rng.random() < 0.5
        words = [f"word{k}" for k in rng.integers(0, 400, 12)] + ["rotter"] * one + ["islander"] * two
        rows.append((i, " ".join(words), "r", 1))
        labels.append((i, 0, int(one != two)))
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = toxicity.fit(docs, labels).score(docs).where(toxicity.fold("doc_id") == 0).join(labels, "doc_id").collect()
    assert sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in held) >= 0.95 * len(held)


#: Names that the stages use for columns of their own.
HELPERS = (
    "held_row held_terms held_features held_raw held_odds held_class held_score held_text score label label_id mix_size mix_draw copies copy size "
    "taken target source_size plan_source p whole cut_cell last_rank level kept_id kept_key n_rows rows root node text_key keys c1 c2 worded row").split()


@pytest.mark.parametrize("stage", ["toxicity", "near duplicates", "mixing"])
def test_names_of_the_users_columns_do_not_matter(spark, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.select("*", *[(F.col("doc_id") * 100 + k).alias(name) for k, name in enumerate(HELPERS)])
    got = run(spark, extra, SF)
    assert got.columns == extra.columns
    rows = got.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in run(spark, docs, SF).collect())
    assert all(r[name] == r["doc_id"] * 100 + k for r in rows for k, name in enumerate(HELPERS))


def test_scores_leave_a_column_of_that_name_alone(spark):
    docs, labels = labelled(spark)
    named = docs.withColumn("score", F.lit("mine"))
    scored = toxicity.fit(docs, labels).score(named)
    assert scored.columns == [*named.columns, "score_"] and scored.where("score <> 'mine'").isEmpty()


def test_labels_of_one_kind_give_their_share(spark):
    docs, labels = labelled(spark)
    for kind in (0, 1):
        one = labels.withColumn("toxic", F.lit(kind))
        assert {r["score"] for r in toxicity.fit(docs, one).score(docs).collect()} == {float(kind)}


def test_pipeline_stages_follow_each_other(spark):
    """Each stage against its operator by brute force, on what the stage before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = kept
        kept = shared.materialise(stage(spark, kept, SF), "test-stage")
        assert kept.columns == docs.columns, name
        rows = [(r["doc_id"], r["text"]) for r in before.collect()]
        got = sorted(r["doc_id"] for r in kept.collect())
        if name == "near duplicates":
            _, roots = brute_near(rows)
            assert got == sorted(i for i, root in roots.items() if i == root)
        if name == "mixing":
            mixed = mixing.mix(before).collect()
            assert got == sorted(r["doc_id"] for r in mixed for _ in range(r["copies"]))
    packed = corpus_pipeline.run(spark, SF)
    assert packed.count() == packing.pieces(kept).count()
