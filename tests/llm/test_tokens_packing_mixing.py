"""Token counts, packing and mixing against their libraries and brute force."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF
from tidewatch.llm import mixing, packing, tokens
from tidewatch.llm.byte_bpe import ByteBpe

SCHEMA = "doc_id long, text string, source string, n_tokens int"
ODD = [
    (1, None, "b", 1), (2, "", None, None), (3, "a  b\n\nc \n d\t e ", "a", 1), (3, "a  b\n\nc \n d\t e ", "a", 1),
    (None, "x<|endoftext|>y  z <s> </s> ▁ \0 ü€𝄞", "a", 1), (4, "word " * 9000, "hot", 1), (5, "é" * 3000, "hot", 1),
    (6, "Don't we'll 12345 ... !!\r\n ok　wide\xa0nb", "hot", 1), (6, " lead and trail ", "hot", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def test_token_counts_equal_the_library(spark, odd):
    model = tokens.load(public_tokenizers.path(tokens.MODEL))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(odd.select("doc_id", "text"))
    want = sorted((repr(r["doc_id"]), len((r["text"] or "").encode()), len(model.encode(r["text"] or ""))) for r in docs.collect())
    for chunk, overlap in ((tokens.CHUNK, tokens.OVERLAP), (400, 60)):
        got = tokens.count_tokens(docs, chunk=chunk, overlap=overlap).collect()
        assert sorted((repr(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want


def test_overlap_is_widened_where_no_boundary_is_proven(spark):
    model = tokens.load(public_tokenizers.path(tokens.MODEL))
    texts = ["a" * 5000 + " end", "ab" * 900 + " x " * 50 + "ab" * 900]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(docs, chunk=200, overlap=20).collect()}
    assert got == {i: len(model.encode(t)) for i, t in enumerate(texts)}


def test_pieces_equal_the_library(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    want = []
    for r in docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((repr(r["doc_id"]), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got = packing.pieces(docs, with_ids=True).collect()
    assert sorted((repr(r[0]), *r[1:5]) for r in got) == sorted(want)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)


PIECES = ["a", "b", " ", "1", "\n", "\t", ".", ",", "'", "é", "€", "\0", "\x0b", "\r", "　", "s", "  ", "'ll", "<|endoftext|>", "<|end", "\x1c", "\x85", "\xa0",
          "中文", "👩\u200d👧", "ß", "\u180e", "\u200b", "½", "٣", "n\u0303", "word", " and", "\ufeff", "𝄞", "x" * 1200, " " * 1100]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join), st.booleans())
def test_ids_equal_the_library(text, special):
    from tokenizers import Tokenizer

    if not hasattr(test_ids_equal_the_library, "both"):
        path = public_tokenizers.path(packing.TOKENIZER)
        library = {s: Tokenizer.from_file(path) for s in (True, False)}
        library[False].encode_special_tokens = True
        test_ids_equal_the_library.both = {s: (ByteBpe(path, s), library[s]) for s in (True, False)}
    bpe, library = test_ids_equal_the_library.both[special]
    assert bpe.fast is not None
    assert bpe.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_sequences_are_gapless_and_few(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = packing.pack_documents(docs).collect()
    assert len(rows) == packing.pieces(docs).count()
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert len(bins) <= -(-total // 1024) + max(1, len(bins) // 100)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=6), st.integers(0, 40))
def test_fullest_is_the_best_filling(left, room):
    best = {0}
    for length, n in left.items():
        best = {s + k * length for s in best for k in range(n + 1) if s + k * length <= room}
    chosen = packing.fullest(sorted(left, reverse=True), left, room)
    assert sum(k * n for k, n in chosen.items()) == max(best)
    assert all(n <= left[k] for k, n in chosen.items())


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert packing.pack_documents(none).count() == 0
    assert tokens.count_tokens(none).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def brute_targets(sizes, weights):
    capped, total = set(), sum(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(3 * sizes[i] for i in capped)
        goal = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if goal[i] > 3 * sizes[i]]
        if not over:
            return [3 * sizes[i] if i in capped else goal[i] for i in range(len(sizes))]
        capped.update(over)


def test_targets_reshare_the_excess(spark):
    sizes = [5, 100, 7, 3000, 1, 900, 0, 40]
    names = [*"abcdefg", None]
    got = mixing.targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).collect()
    want = brute_targets(sizes, [1, 2, 3, 1, 2, 3, 1, 2])
    assert {r["source"]: r["target"] for r in got} == pytest.approx(dict(zip(names, want)))


def test_mix_is_near_its_targets(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").unionByName(odd.select("doc_id", "text", "source"))
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    named = {(r["doc_id"]): r["source"] for r in docs.collect()}
    taken, target, largest = {}, {}, {}
    for r in rows:
        s = named[r["doc_id"]]
        taken[s] = taken.get(s, 0) + r["taken"]
        target[s] = r["target"]
        largest[s] = max(largest.get(s, 0), r["size"])
    for s in taken:
        if s not in ("a", "hot"):  # their ids repeat
            assert abs(taken[s] - target[s]) <= largest[s]
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(docs.repartition(3)).collect()))


def test_mixed_documents_repeat_rows(spark, odd):
    copies = {}
    for r in mixing.mix(odd).collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + r["copies"]
    got = mixing.mixed_documents(odd)
    assert got.columns == odd.columns
    assert got.groupBy("doc_id").count().count() == sum(n > 0 for n in copies.values())
    assert got.count() == sum(copies.values())


def test_equal_rows_are_packed_each_on_its_own(spark, monkeypatch):
    """Most rows are one text under one id; their places differ, and buckets share them."""
    monkeypatch.setattr(packing, "BUCKET_ROWS", 16)
    docs = spark.createDataFrame([(7, "the same text again", "s", 1)] * 300 + [(k, "word " * k, "s", 1) for k in range(50)], SCHEMA).selectExpr(
        "*", "1 as row", "'x' as bucket", "2 as length").repartition(3)
    rows = packing.pack_documents(docs).collect()
    assert len(rows) == 350 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 350
