import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from tests.conftest import plan
from tidewatch.llm import alignment, manifest, sharding
from tidewatch.llm.shared import free_name

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def by_sql(rows, sql):
    """The SQL's rows over ``rows`` as documents."""
    con = duckdb.connect()
    con.sql("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    for start in range(0, len(rows), 500):
        some = rows[start:start + 500]
        con.execute(f"INSERT INTO documents VALUES {', '.join(['(?, ?, ?, ?, ?)'] * len(some))}", [v for r in some for v in r])
    found = con.sql(sql)
    return sorted(map(repr, found.fetchall())), list(found.columns)


def corpus(n, seed, copies=0.3):
    """Rows of which a share are copies of one text, in a source that holds half of all, with nulls and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        text = "the same text " * 9 if rng.random() < copies else " ".join(rng.choice("Aa bB c é 中 ".split()) for _ in range(rng.randint(0, 60)))
        rows.append((k, rng.choice([text, text, text, None, ""]) if k % 10 == 0 else text, rng.choice(["en", None]),
                     "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "Ä", None]), rng.choice([5, None])))
    return rows + [(None, "no id", "en", None, 1)] * 2 + rows[:5] + rows[:1] * 40


# Sharding.

def shards(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("range_rows, fan_out", [(1024, 1024), (8, 4)])
def test_shards_equal_the_sql(spark, monkeypatch, range_rows, fan_out):
    """Also where most ranges are overfull and are split again and again."""
    monkeypatch.setattr(sharding, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(sharding, "FAN_OUT", fan_out)
    rows = corpus(400, 1)
    found = sharding.sharded(table(spark, rows))
    got = shards(found.selectExpr("doc_id", "size", "text_crc32", f"'{sharding.LAW}'", "shard", "slot", "cast(null as int)"))
    assert got == by_sql(rows, sharding.OP11_SQL)[0]


def test_ranges_hold_few_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 16)
    monkeypatch.setattr(sharding, "FAN_OUT", 4)
    rows, ranges = sharding.ranged(sharding.keyed(table(spark, corpus(500, 2, copies=0.6))))
    held = rows.groupBy("range").count().collect()
    assert max(r["count"] for r in held) <= 16
    assert sorted((r["range"], r["count"]) for r in held) == sorted((r["range"], r["n"]) for r in ranges.collect())


def test_shards_are_even_and_keep_copies_together(spark, monkeypatch):
    monkeypatch.setattr(sharding, "WHOLE", 50)
    rng = random.Random(5)
    rows = [(k, "x" * rng.randint(50, 150) + str(k // 2), None, None, 0) for k in range(6000)]
    rows = [(k, rows[k - 1][1] if k % 2 else t, *rest) for k, (_, t, *rest) in enumerate(rows)]
    found = sharding.sharded(table(spark, rows)).collect()
    sizes = np.bincount([r["shard"] for r in found], [r["size"] for r in found], sharding.SHARDS)
    assert sizes.max() - sizes.min() < 0.02 * sizes.mean()
    together = {}
    for r in found:
        together.setdefault(r["text_crc32"], set()).add(r["shard"])
        assert r["size"] == len(rows[r["doc_id"]][1]) + 1 and r["text_crc32"] == zlib.crc32(rows[r["doc_id"]][1].encode())
    assert all(len(x) == 1 for x in together.values())
    for shard in range(sharding.SHARDS):
        slots = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_a_text_of_most_rows_is_spread(spark):
    rows = [(k, "same", None, "s", 4) for k in range(900)] + [(k, f"other {k}", None, "s", 4) for k in range(900, 1000)]
    sizes = sharding.sharded(table(spark, rows)).groupBy("shard").agg({"size": "sum"}).collect()
    assert len(sizes) == sharding.SHARDS
    assert max(r[1] for r in sizes) - min(r[1] for r in sizes) <= 2 * 10


def test_sharded_documents(spark):
    rows = corpus(200, 3)[:200]
    docs = table(spark, [(*r, k, "u") for k, r in enumerate(rows)], DOCS + ", shard long, text_key string")
    found = sharding.shard_documents(docs, 4)
    assert found.columns == [*docs.columns, "shard_"]
    of = {r["doc_id"]: r["shard"] for r in sharding.sharded(docs, 4).collect()}
    for r in found.collect():
        assert r["shard_"] == of[r["doc_id"]] and r["shard"] == r["doc_id"] and r["text_key"] == "u"


def test_sharding_is_native(spark):
    shown = plan(sharding.sharded(table(spark, corpus(20, 4))))
    assert "Python" not in shown and "Arrow" not in shown


def test_empty_tables(spark):
    docs = table(spark, [])
    assert sharding.sharded(docs).collect() == []
    assert sharding.shard_documents(docs).collect() == []
    assert manifest.manifest(docs).collect() == []
    assert alignment.aligned(docs).collect() == []
    assert alignment.spans(docs).collect() == []


def test_free_names(spark):
    assert free_name(table(spark, []), "shard") == "shard"
    assert free_name(table(spark, [], DOCS + ", Shard int, shard_ int"), "shard") == "shard__"


# Manifest.

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(digests):
    """All levels of a tree, by lists."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k:k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, at):
    out = []
    for level in levels[:-1]:
        start = at - at % 16
        out.append((at - start, level[start:start + 16]))
        at //= 16
    return out


def brute_manifest(rows):
    def one(doc_id, text, lang, source, n_chars):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, one(*r))) for s in sources}
    trees = {s: tree([one(*r) for r in groups[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for at, r in enumerate(groups[s]):
            steps = path(trees[s], at) + path(top, k)
            leaf = end = one(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                end = one(r[0], r[1] and r[1].translate(lower), *r[2:])
            for place, run in steps:
                end = sha(*run[:place], end, *run[place + 1:])
            proof = sha(*(x for place, run in steps for j, x in enumerate(run) if j != place))
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], proof, end, end == top[-1][0]))
    return sorted(map(repr, out))


@pytest.mark.parametrize("n, seed", [(1, 1), (60, 2), (900, 3)])
def test_manifest_equals_brute_force_and_sql(spark, n, seed):
    rows = corpus(n, seed)
    found = manifest.manifest(table(spark, rows))
    got = sorted(repr(tuple(r)) for r in found.collect())
    assert got == brute_manifest(rows)
    sql, columns = by_sql(rows, manifest.OP13_SQL)
    assert got == sql and found.columns == columns


def test_many_sources_and_clashing_columns(spark):
    rows = [(k, "T", "en", f"s{k % 300}", k) for k in range(700)]
    extra = [(*r, "x", 9, "p", None, 5) for r in rows]
    docs = table(spark, extra, DOCS + ", tree string, place long, digest string, path string, n long")
    assert sorted(repr(tuple(r)) for r in manifest.manifest(docs).collect()) == brute_manifest(rows)


def test_one_document_is_its_own_root(spark):
    row = manifest.manifest(table(spark, [(7, "a", None, None, None)])).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == sha("")


def test_lift_follows_the_queue():
    block = [str(k) for k in range(40)]
    levels = manifest.lift(block, 2)
    assert levels == tree(block)
    assert manifest.lift(["x"], 0) == [["x"]] and manifest.lift(["x"], 2) == [["x"], [sha("x")], [sha(sha("x"))]]


# Alignment.

class Whole:
    """Both tokenizers on whole texts."""

    def __init__(self):
        self.a = tokenizers.Tokenizer.from_file(public_tokenizers.path(alignment.TOKENIZER_A))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.MODEL_B))
        self.known = alignment.Tokenizers(public_tokenizers.path(alignment.TOKENIZER_A), public_tokenizers.path(alignment.MODEL_B))

    def groups(self, text):
        """Lists of A and B ids by group."""
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        left, right = [self.known.bytes_a[x] for x in a], [self.known.bytes_b[x] for x in b]
        if not b"".join(left) == b"".join(right) == (" " + text).encode():
            return []
        ends_a, ends_b = np.cumsum([len(x) for x in left]), np.cumsum([len(x) for x in right])
        out, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            to_a, to_b = np.searchsorted(ends_a, end) + 1, np.searchsorted(ends_b, end) + 1
            out.append((a[i:to_a], b[j:to_b]))
            i, j = to_a, to_b
        return out


@pytest.fixture(scope="module")
def whole():
    return Whole()


def brute_alignment(whole, rows):
    groups = [whole.groups(text) for _, text in rows]
    links = [[(x, y) for a, b in found for x in a for y in b] for found in groups]
    counts = {}
    for some in links:
        for pair in set(some):
            counts[pair] = counts.get(pair, 0) + 1
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for (doc_id, _), found, some in zip(rows, groups, links):
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found)
        out.append((doc_id, sum(len(a) for a, _ in found), sum(len(b) for _, b in found), len(found), len(some),
                    sum(counts[x] == most[x[0]] for x in some), sum(counts[x] for x in some), sha(shown) if shown else ""))
    return sorted(map(repr, out))


ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "x\ny \n z\t", "a ▁ b", "▁", "<s> </s> <|endoftext|> <0x41>", "\0", "é　ﬁ x",
       "don't we'll 's  't", "中文 文字 👩‍👩‍👧 ok", "aaaa" * 300, "12345 6,7.8", "a b c d", "ﷺ ​ x", "word " * 50 + "end", "\x1c a \x85 b"]


def test_alignment_equals_brute_force(spark, whole):
    rng = random.Random(8)
    alphabet = list("abcdeABC     \n\t.,'0129éß中文▁<>|") + ["the", "ing", " and", "  ", "\r\n", "👍", " "]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    words = ["".join(rng.choice("aeiounrst") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(100)]
    rows = list(enumerate(texts)) + [(None, "null id"), (3, "repeated"), (3, "repeated")]
    docs = table(spark, [(*r, 1, "x") for r in rows], "doc_id long, text string, row long, pairs string")
    expected = brute_alignment(whole, rows)
    for frequent in (alignment.FREQUENT, 40, 1):
        assert sorted(repr(tuple(r)) for r in alignment.aligned(docs, frequent).collect()) == expected


def test_white_space_at_the_ends_of_texts_stays_in_its_text(whole):
    texts = ["a ", " b", "c\n", "\nd", "  ", "e", "", " ", "f  ", "  g h", "i\t", "\u3000j", "k ▁", " l", "m\x85", " n o "]
    for order in (texts, texts[::-1], texts[3:] + texts[:3]):
        sizes, groups, _, _ = alignment.Segments(whole.known).documents(order)
        for size, shown, found in zip(sizes.tolist(), groups, map(whole.groups, order)):
            assert shown == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found)
            assert size[:3] == [sum(len(a) for a, _ in found), sum(len(b) for _, b in found), len(found)]


def test_forgetting_segments_changes_nothing(whole, monkeypatch):
    monkeypatch.setattr(alignment, "SEGMENTS", 3)
    segments = alignment.Segments(whole.known)
    texts = ["one two three", "four five six seven", None, "one two ▁", "one six"]
    for text in texts * 2:
        sizes, groups, held, pairs = segments.documents([text])
        found = whole.groups(text)
        assert groups[0] == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found)
        links = {}
        for a, b in found:
            for x in a:
                for y in b:
                    links[x << 32 | y] = links.get(x << 32 | y, 0) + 1
        assert dict(zip(pairs[held.column].tolist(), held.entry.tolist())) == links


def test_product_equals_dense():
    rng = np.random.default_rng(3)
    for _ in range(30):
        m, k, n = rng.integers(1, 8, 3)
        one, other = rng.integers(0, 3, (m, k)), rng.integers(0, 3, (k, n))
        sparse = [alignment.rows_of(*np.nonzero(x), x[np.nonzero(x)], x.shape) for x in (one, other)]
        found, dense = alignment.product(*sparse), np.zeros((m, n), "int64")
        row = np.repeat(np.arange(m), np.diff(found.start))
        dense[row, found.column] = found.entry
        assert (dense == one @ other).all()
        back = alignment.transposed(alignment.transposed(sparse[0]))
        assert all((np.asarray(x) == np.asarray(y)).all() for x, y in zip(back, sparse[0]))


def test_frequent_pairs_are_bounded(spark):
    docs = table(spark, [(k, f"word{k % 7} and text {k % 3}") for k in range(60)], "doc_id long, text string")
    counts = alignment.pair_counts(alignment.materialise(alignment.encoded(docs), "test"))
    for parts in (1, 3, 10, 1000):
        assert len(alignment._frequent(counts, parts)[0]) <= parts


def test_spans_cover_the_bytes(spark, whole):
    text = "Don't stop, übermäßig 中文 words"
    rows = alignment.spans(table(spark, [(1, text), (2, None)], "doc_id long, text string")).orderBy("group").collect()
    assert [(r["ids_a"], r["ids_b"]) for r in rows] == [(list(a), list(b)) for a, b in whole.groups(text)]
    assert rows[0]["start"] == 0 and rows[-1]["stop"] == len((" " + text).encode())
    assert all(x["stop"] == y["start"] for x, y in zip(rows, rows[1:]))
