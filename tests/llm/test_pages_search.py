"""Pages, URLs, license scans and search against brute force and own rows."""

import math
import textwrap
from collections import Counter

import duckdb
import numpy as np
import pytest

from tests.conftest import SF
from tidewatch.llm import licenses, pages, search, urls


def page(host, number, story, comment=""):
    return (number, f"https://{host}/{number}", f"""<!DOCTYPE html><html><head><title>t</title><style>p {{}}</style></head><body>
        <header><a href=/>{host}</a></header><nav><ul><li><a href=/a>Home<li><a href=/b>About {number}</ul></nav>
        <div id=cookie-notice>We use cookies &amp; more</div><!-- <p>no</p> --><script>var x = "<p>no</p>";</script>
        <div class="post">{story}<p>Thank you for reading our stories.</p></div><aside><p>Other news {number}</p></aside>
        <div class='comments'><p>{comment}</p></div><form><input name=q><label>Search</label></form><footer>&copy; {host} {number}</footer></body></html>""")


STORY = "<h1>Title &lt;{0}&gt;</h1><p>First  part\n of {0} is <b>bold</b>, and <a href=x>linked</a>.<p>Second&nbsp;part of {0}.<br>More text, long enough to count.<ul><li>one {0}<li>two {0}</ul>"


def test_varying_slots_are_the_text(spark):
    rows = [page("a.example", k, STORY.format(k), f"Nice {k}!") for k in range(8)]
    odd = [(90, None, None), (91, "https://a.example/x", ""), (92, "no url", "<p>alone"), (93, "https://b.example/", "<article><p>x</p><article class=comment>c</article></article>"),
           (None, "https://a.example/1", rows[1][2])]
    docs = spark.createDataFrame([*rows, *odd], "page_id long, url string, html string")
    got = pages.main_texts(docs).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    for k in range(8):
        # The closing line is on every page of the host: template.
        assert texts[k] == f"Title <{k}>\nFirst part of {k} is bold, and linked.\nSecond part of {k}. More text, long enough to count.\none {k}\ntwo {k}"
    assert texts[90] == texts[91] == "" and texts[92] == "alone" and texts[93] == "x" and texts[None] == texts[1]
    assert len(got) == len(rows) + len(odd)


def test_text_beside_the_largest_part_stays(spark):
    bodies = {"a": "<pre>{0} {1}</pre><p>End of {0}</p>", "b": "<div class=lead>Lead {0}</div><div class=body>{0} {1}</div><div class=terms>Same terms</div>",
              "c": "<article><p>Short {0}</p></article><div class=rest><p>{0} {1}</p></div>", "d": "<article><p>{0} {1}</p></article><div><p>Same</p></div>"}
    rows = [(k, f"https://{host}.example/{k}", f"<html><body>{body.format(k, 'long text ' * 20)}</body></html>") for host, body in bodies.items() for k in range(6)]
    long = " ".join(["long text"] * 20)
    got = {r["url"]: r["text"] for r in pages.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got["https://a.example/3"] == f"3 {long}\nEnd of 3" and got["https://b.example/3"] == f"Lead 3\n3 {long}"
    assert got["https://c.example/3"] == f"Short 3\n3 {long}" and got["https://d.example/3"] == f"3 {long}"


def extracted(html, rules=None):
    return pages.extract(pages.parse(html), rules)


@pytest.mark.parametrize("html, text", [
    ("<p title=it's>It's main text</p><p>Second, don't lose</p>", "It's main text\nSecond, don't lose"),
    ("<p title=it's>Main text</p>", "Main text"), ("<a href='x>y' title=\"q>\">z</a><p>t", "z\nt"), ("<p a= b c>x<p d=>y", "x\ny"),
    ("<p title='class=ad'>kept</p>", "kept"), ("<p data-class=ad>kept</p>", "kept"), ("<p class=\"x ad\">lost</p><p>kept", "kept"),
    ("<article><header><div><h1>Title</h1></div></header><p>x</p></article>", "Title\nx"),
    ("<header><p>Site</p></header><article><p>x</p></article>", "x"),
    ("<div class='post banner-less'><p>Text one.</p></div>", "Text one."), ("<div class=alert><p>only</p></div>", "only"),
    ("<article><p>A</p><p class='share-price'>B</p><div id='related-work'>C</div><p class='comments-on-plato'>D</p><p class=alert>E</p>"
     "<div class=comments>F</div><div class='related-posts'><a href=x>G</a></div><div class=site-footer>H</div></article>", "A\nB\nC\nD\nE"),
    ("<form action=x><h1>T</h1><p>Body</p><input name=q></form>", "T\nBody"), ("<form><label>Search</label></form><p>hello</p>", "hello"),
    ("<form>words here are most of the page<input></form><p>x</p>", "words here are most of the page\nx"),
])
def test_one_page(html, text):
    assert extracted(html) == text


def test_deep_and_long_pages():
    deep = "<div>" * 100_000 + "<p>deep</p><nav>menu</nav><p>more" + "</div>" * 100_000 + "<p>after"
    assert extracted(deep) == "deep\nmore\nafter"
    assert pages.rules_of(pages.merge_pages(pages.tree_of(pages.parse(deep)), pages.tree_of(pages.parse(deep))))
    assert extracted("<article>" + "<p>word &amp; word</p>" * 100_000 + "</article>") == "\n".join(["word & word"] * 100_000)


def test_a_host_of_copies_keeps_its_text(spark):
    """Near copies of one article share most of it, which is text and not template, however many they are."""
    body = "<html><body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>First paragraph of it.</p><p>Second paragraph of it.</p><p>Edition {0}.</p></article></body></html>"
    rows = [(100 * n + k, f"https://copies{n}.example/{k}", body.format(k)) for n in (1, 2, 4, 6, 30) for k in range(n)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "'x' as rules", "2 as text")
    got = {r["page_id"]: r["text"] for r in pages.main_texts(docs).collect()}
    assert got == {i: f"Title\nFirst paragraph of it.\nSecond paragraph of it.\nEdition {i % 100}." for i, _, _ in rows}
    assert pages.main_texts(docs.limit(0)).count() == 0


def test_a_text_on_few_pages_of_a_host_is_not_template(spark):
    """Ten of forty pages have a table with the same cell."""
    rows = [(k, f"https://t.example/{k}", f"<html><body><article><p>Story number {k} is told here at some length.</p>"
             + ("<table><tr><td>Same cell</td></tr></table>" if k < 10 else "") + "</article></body></html>") for k in range(40)]
    got = {r["page_id"]: r["text"] for r in pages.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story number 3 is told here at some length.\nSame cell" and got[30] == "Story number 30 is told here at some length."


def brute_matched(one, two):
    """Most pairs over all ways to align the children in order."""
    if one["k"] != two["k"]:
        return 0

    def best(a, b):
        if not a or not b:
            return 0
        return max(best(a[1:], b), best(a, b[1:]), brute_matched(a[0], b[0]) + best(a[1:], b[1:]))

    return 1 + best(one["x"], two["x"])


def test_tree_matching_equals_all_alignments():
    rng = np.random.default_rng(5)

    def tree(depth):
        return {"k": "abc"[rng.integers(3)], "x": [tree(depth - 1) for _ in range(rng.integers(0, 4))] if depth else []}

    for _ in range(60):
        one, two = ({"k": "r", "x": [tree(2) for _ in range(3)]} for _ in range(2))
        assert pages.matched(one, two) == brute_matched(one, two)


def test_tree_matching_counts_aligned_nodes():
    trees = [pages.tree_of(pages.parse(h)) for h in ("<div><h1>a</h1><p>b</p><ul><li>c</ul></div>", "<div><p>x</p><ul><li>y</ul><h1>z</h1></div>")]
    # Root, div, and p > ul > li in order; h1 crosses over.
    assert pages.matched(*trees) == 5


def test_articles_of_the_table(spark):
    import html as entities
    import re

    table = spark.read.parquet(f"{SF}/pages.parquet")
    texts = {r["page_id"]: r["text"] for r in pages.main_texts(table).collect()}
    for r in table.collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S).group(1)
        parts = (re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", article))
        assert texts[r["page_id"]] == "\n".join(x for x in parts if x)


def test_urls_pass_the_filter_exactly(spark):
    rows = [(1, "http://A.Example.ORG/es/1"), (2, "https://example.org/en/19?q"), (3, "http://x.com/de/"), (4, "http://x.com/fr/a"), (5, "http://www.ads-track.net/a/"),
            (6, "ftp://ads-track.net/a#b"), (7, None), (8, "nothing"), (9, "http://notorg/"), (10, "http://ads-track.com"), (10, "http://ads-track.com"), (None, "http://other.net/\nx?y")]
    rows += [(100 + k, f"http://spam-farm.net/{k}") for k in range(300)] + [(1000 + k, f"http://good.net/{k}") for k in range(300)]
    table = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'clash' as block", "1 as w0")
    got = urls.judge(table, urls.listed_urls(table)).collect()
    want = {1: "example.org/es/", 2: "example.org/en/1", 3: "com/de/", 4: "com/fr/"}
    verdicts = {r["page_id"]: r["verdict"] for r in got}
    assert {r["page_id"]: r["rule"] for r in got if r["rule"]} == want and len(got) == len(rows)
    assert [verdicts[k] for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None)] == [
        "block", "block", "block", "allow", "block", "block", "allow", "allow", "allow", "block", "allow"]
    assert all(verdicts[100 + k] == "block" and verdicts[1000 + k] == "allow" for k in range(300))
    hosts = {r["page_id"]: (r["host"], r["path"]) for r in got}
    assert hosts[1] == ("a.example.org", "/es/1") and hosts[7] == hosts[8] == ("", "") and hosts[None] == ("other.net", "/\nx")
    assert urls.judge(table.limit(0), urls.listed_urls(table)).count() == 0
    assert {r["verdict"] for r in urls.judge(table.where("page_id > 999"), urls.listed_urls(table.limit(0))).collect()} == {"allow"}


def test_licenses_are_told_apart_by_their_words(spark):
    texts = {
        1: "Some text\nLicensed under CC BY-NC 4.0.\nmore", 2: "Licensed under CC BY 4.0.", 3: "Licensed under the Apache License, Version 2.0.",
        4: "this work is licensed under the gnu general public license, version 3. (c) Me", 5: "a license to kill", 6: None, 7: "",
        8: "x\n" * 3000 + "Released under the MIT License.", 9: "Licensed under the Apache License, Version 1.1.", 10: "All rights reserved.",
        11: "This work is licensed under the GNU Lesser General Public License, version 3.",
    }
    docs = spark.createDataFrame([*texts.items(), (1, texts[1])], "doc_id long, text string").selectExpr("*", "'clash' as block")
    rows = licenses.scan(docs).collect()
    found = {r["doc_id"]: r for r in rows}
    assert {i: r["license"] for i, r in found.items()} == {
        1: "CC-BY-NC-4.0", 2: "CC-BY-4.0", 3: "Apache-2.0", 4: "GPL-3.0", 8: "MIT", 9: "Apache-1.1", 10: "Proprietary", 11: "LGPL-3.0"}
    assert sum(r["doc_id"] == 1 for r in rows) == 2 and found[8]["start"] == 3000 and found[1]["start"] == 1
    assert found[1]["missing"] == [] and found[9]["missing"] == [] == found[9]["added"] and found[4]["added"] == ["c", "me"]
    assert licenses.scan(docs.limit(0)).count() == 0


def test_every_notice_of_a_block_is_found(spark):
    texts = {
        1: "\n".join(["Released under the MIT License."] * 5), 2: "Licensed under CC BY 4.0.\nReleased under the MIT License.",
        3: "The library that we describe here, with all of its parts and tools, is released under the MIT License and can be had from our site.",
        4: "word " * 3000 + "Licensed under the Apache License, Version 2.0. " + "word " * 3000 + "All rights reserved. All rights reserved.",
    }
    found = Counter((r["doc_id"], r["start"], r["license"]) for r in licenses.scan(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect())
    assert found == Counter([*((1, k, "MIT") for k in range(5)), (2, 0, "CC-BY-4.0"), (2, 1, "MIT"), (3, 0, "MIT"), (4, 0, "Apache-2.0"),
                             (4, 0, "Proprietary"), (4, 0, "Proprietary")])


@pytest.mark.parametrize("text, names", [
    ("Released under the GPL License.", ["unknown"]), ("Released under the BSD License.", ["unknown"]),
    ("Licensed under the Eclipse Public License, Version 2.0.", ["EPL-2.0"]), ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0"]),
    ("Licensed under CC BY 3.0.", ["CC-BY-3.0"]), ("Licensed under CC BY-SA 3.0.", ["CC-BY-SA-3.0"]), ("Licensed under CC BY 7.0.", ["unknown"]),
    ("This work is licensed under the GNU Affero General Public License, version 2.", ["unknown"]),
    ("This work is licensed under the Mozilla Public License, version 1.1.", ["MPL-1.1"]),
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
    ("This work is licensed under the GNU General Public License, v3.0.", ["GPL-3.0"]),
    ("Licensed under the Apache License, Version 1.1.", ["Apache-1.1"]), ("Licensed under the Apache License, Version 3.", ["unknown"]),
    ("Not all rights reserved.", []), ("This is not released under the MIT License.", []), ("a license to kill", []),
    ("We said no. Released under the MIT License.", ["MIT"]), ("SPDX-License-Identifier: MIT OR Apache-2.0", ["Apache-2.0", "MIT"]),
    ("SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND Own-1.0", ["GPL-2.0", "unknown"]),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["CC-BY-NC-4.0"]),
])
def test_near_misses_are_not_named(text, names):
    scanner = licenses.Scanner([*licenses.TEMPLATES.items(), *licenses.MORE])
    assert sorted(x[1] for x in scanner.scan(text)) == names


def test_notices_equal_brute_force():
    """Every window and every template: what saves most and is confirmed comes first."""
    rng = np.random.default_rng(6)
    given = [x for x in licenses.TEMPLATES.items() if len(x[1]) < 90]
    scanner = licenses.Scanner(given)
    words = ["code", "of", "ours", "here", "version", "license", "the", "public", "is", "under"]
    for _ in range(200):
        parts = []
        for _ in range(rng.integers(1, 4)):
            notice = given[rng.integers(len(given))][1].rstrip(".").split()
            if rng.random() < 0.3:
                notice[rng.integers(len(notice))] = str(rng.choice(["GPL", "3.0", "thing", "BY-NC", "of"]))
            parts += [*rng.choice(words, rng.integers(0, 6)), *notice, "."]
        block = " ".join(parts)
        tokens = list(licenses.TOKEN.finditer(block))
        text = [licenses.word(m.group()) for m in tokens]
        has, names = list(text), []
        while True:
            best = None
            for template in scanner.given:
                for w in scanner.windows(has, template):
                    before, low = [], w.first
                    while low and w.first - low < licenses.BEFORE and "." not in block[tokens[low - 1].end():tokens[low].start()]:
                        low -= 1
                        before.append(text[low])
                    if scanner.confirmed(w, before):
                        saved = scanner._saved(block[tokens[w.first].start():tokens[w.last - 1].end()], template)
                        key = (-saved, len(w.missing) + len(w.added), template.name, w.first, w.last)
                        best = min(best or (key, w), (key, w), key=lambda x: x[0])
            if best is None:
                break
            names.append(best[1].template.name)
            has[best[1].first:best[1].last] = [None] * (best[1].last - best[1].first)
        assert sorted(x[1] for x in scanner.scan(block) if x[1] != licenses.UNKNOWN) == sorted(names), block


def test_wrapped_and_full_licenses_are_found(spark):
    mit = [t for n, t in licenses.MORE if n == "MIT" and len(t) > 100]
    texts = {
        1: "x\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the\nfollowing conditions are met:\n\ny",
        2: "Released under the MIT\nLicense.", 3: "\n\n".join("\n".join(textwrap.wrap(t, 60)) for t in ["MIT License", "Copyright (c) 2020 Me", *mit]),
        4: "# SPDX-License-Identifier: MIT\ncode", 5: "// SPDX-License-Identifier: GPL-3.0-or-later",
    }
    found = [(r["doc_id"], r["start"], r["license"]) for r in licenses.scan(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()]
    assert sorted(x for x in found if x[0] != 3) == [(1, 2, "BSD-3-Clause"), (2, 0, "MIT"), (4, 0, "MIT"), (5, 0, "GPL-3.0")]
    assert [x[2] for x in found if x[0] == 3] == ["MIT"] * 4


def brute_search(docs, queries, k):
    found = {i: search.terms_of(t) for i, t in docs}
    n, mean = len(docs), sum(map(len, found.values())) / len(docs)
    held = Counter(t for x in found.values() for t in {*x})
    out = {}
    for q, text in queries:
        scores = []
        for i, x in found.items():
            tf, s = Counter(x), 0.0
            for t in sorted({*search.terms_of(text)}):
                if tf[t]:
                    idf = math.log(1 + (n - held[t] + 0.5) / (held[t] + 0.5))
                    s += idf * tf[t] * (search.K1 + 1) / (tf[t] + search.K1 * (1 - search.B + search.B * len(x) / mean))
            if s > 0:
                scores.append((-s, i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("block", [128, 3])
def test_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK", block)
    rng = np.random.default_rng(5)
    words = np.array([f"t{int(k)}" for k in rng.zipf(1.3, 4000) % 300])
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 60)))) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(15)] + [(2000, None), (2001, "")]
    queries = [(q, " ".join(rng.choice(words, 1 + q % 9))) for q in range(40)] + [(50, ""), (51, None), (52, "unseen"), (53, docs[3][1])]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1.0 as score").repartition(5)
    got = {}
    for r in search.search(table, spark.createDataFrame(queries, "query_id long, query string"), k=7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    want = brute_search(docs, queries, 7)
    for q, _ in queries:
        assert [i for i, _ in got.get(q, [])] == [i for i, _ in want[q]]
        assert [s for _, s in got.get(q, [])] == pytest.approx([s for _, s in want[q]])


def mixed_shard(rng, often, n=600):
    """A shard of documents with frequent and rare terms and some equal ones, and a block of queries."""
    words = [f"t{i:03d}" for i in range(400)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 50), p=often)) for _ in range(n - 30)]
    docs = [(i, x) for i, x in enumerate(texts + texts[:30])]
    return docs, [(q, " ".join(rng.choice(words, 1 + q % 40, p=often))) for q in range(60)] + [(100 + q, texts[q]) for q in range(40)]


def spread_terms(power):
    often = 1.0 / np.arange(1, 401) ** power
    return often / often.sum()


@pytest.mark.parametrize("share, most, block, together", [(0.05, 1024, 16, 128), (2.0, 1024, 16, 7), (0.0, 1024, 16, 7), (0.05, 3, 16, 1), (0.05, 1024, 128, 7)])
def test_frequent_and_rare_terms_give_the_same_scores(spark, monkeypatch, share, most, block, together):
    for name, value in (("OFTEN", share), ("OFTEN_TERMS", most), ("BLOCK", block), ("TOGETHER", together), ("QUERIES", 16)):
        monkeypatch.setattr(search, name, value)
    docs, queries = mixed_shard(np.random.default_rng(3), spread_terms(1.0))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {}
    for r in search.search(table, spark.createDataFrame(queries, "query_id long, query string"), k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    want = brute_search(docs, queries, 5)
    for q, _ in queries:
        assert [i for i, _ in got.get(q, [])] == [i for i, _ in want[q]]
        assert [s for _, s in got.get(q, [])] == pytest.approx([s for _, s in want[q]], rel=1e-12)


def test_few_candidates_are_scored_exactly(monkeypatch):
    """Of 6,000 documents and 30 queries some ten each are scored again, not all that hold a term."""
    rng = np.random.default_rng(4)
    taken = []
    monkeypatch.setattr(search.Shard, "_take", lambda self, docs, *rest: taken.append(len(docs)))
    n, terms = 6000, 300
    parts = [np.sort(rng.choice(n, n // (2 + t // 10), replace=False)) for t in range(terms)]
    names = [f"t{t:03d}" for t in range(terms)]
    held = np.array([len(x) for x in parts], "uint32")
    shard = search.Shard([*range(n)], " ".join(names), held.tobytes(), np.concatenate(parts).astype("uint16").tobytes(),
                         rng.integers(1, 9, held.sum()).astype("uint8").tobytes(), rng.integers(20, 200, n).tobytes(), 100.0)
    which = [np.sort(rng.choice(terms, 60, replace=False)) for _ in range(30)]
    block = search.Block([str(q) for q in range(30)], " ".join(names), held.astype("int64").tobytes(),
                         np.full(30, 60).tobytes(), np.concatenate(which).astype("int32").tobytes(), n)
    shard.search(block, 10)
    assert len(taken) == 30 and 10 <= min(taken) and max(taken) <= 40


def test_ranges_of_a_shard_hold_documents_that_are_alike(spark):
    rng = np.random.default_rng(6)
    docs = [(i, " ".join(f"{'ab'[i % 2]}{k}" for k in rng.choice(60, 25))) for i in range(512)]
    held = search.shards(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    assert sorted(i for r in held for i in r["ids"]) == [*range(512)]
    assert [{i % 2 for i in r["ids"][start:start + search.BLOCK]} for r in held for start in range(0, 512, search.BLOCK)] in [
        [{0}, {0}, {1}, {1}], [{1}, {1}, {0}, {0}]]


def test_limits_of_the_first_shard_leave_out_documents_of_others(spark):
    """Only what reaches the limit is scored exactly and returned; a document at the limit is."""
    n, names = 300, ["a", "b"]
    at = np.tile(np.arange(n, dtype="uint16"), 2)
    tf = np.concatenate([np.full(n, 1), 1 + np.arange(n) // 100]).astype("uint16")
    shard = search.Shard([*range(n)], "a b", np.full(2, n, "uint32").tobytes(), at.tobytes(), tf.tobytes(), np.full(n, 5, "int64").tobytes(), 5.0)
    given = (["q"], " ".join(names), np.full(2, n, "int64").tobytes(), np.array([2], "int64").tobytes(), np.arange(2, dtype="int32").tobytes(), 1000)
    free = search.Block(*given)
    shard.search(free, 150)
    assert [x[2] for x in free.best[0]] == [*range(200, 300), *range(100, 150)]
    limited = search.Block(*given, np.array([-free.best[0][0][0]]).tobytes())
    shard.search(limited, 150)
    assert limited.best[0] == free.best[0][:100]


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "query_id long, query string")
    assert search.search(none, asked).count() == 0
    assert search.search(none, asked.limit(0)).count() == 0


def test_url_sql_runs():
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{SF}/pages.parquet'")
    assert con.sql(urls.OP6_SQL).fetchall()


def test_documents_of_every_twentieth_id_are_the_queries(spark, monkeypatch):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in table.collect()]
    # Several blocks of queries.
    monkeypatch.setattr(search, "QUERIES", 3)
    got = {}
    for r in search.op9_exact_search(spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    want = brute_search(docs, [d for d in docs if d[0] % 20 == 0], search.K)
    assert len(want) == 10 and {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items() if x}
    assert all([s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-6) for q in got)


def test_queries_under_one_id_get_their_own_results(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (None, "b c")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "a"), (7, "c"), (8, "c"), (None, "A")], "query_id long, query string")
    got = Counter((r["query_id"], r["rank"], r["doc_id"]) for r in search.search(docs, asked).collect())
    assert got == Counter([(7, 1, 1), (7, 1, 2), (7, 2, None), (8, 1, 2), (8, 2, None), (None, 1, 1)])


@pytest.mark.parametrize("most, width", [(255, 1), (256, 2), (70_000, 4)])
def test_counts_of_a_shard_take_as_few_bytes_as_they_need(spark, most, width):
    docs = [(1, "often " * most + "once"), (2, "often"), (3, None), (4, "once more")]
    table = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    held = search.shards(table).collect()
    assert sum(len(r["tf"]) for r in held) == width * sum(len(r["at"]) // 2 for r in held)
    queries = [(7, "often once"), (8, "more")]
    found = search.search(table, spark.createDataFrame(queries, "query_id long, query string"), 3).collect()
    expected = brute_search(docs, queries, 3)
    got = {q: [(r["doc_id"], pytest.approx(r["score"])) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q, _ in queries}
    assert got == expected
