"""Operators 11 to 13 against plain versions, and on odd tables."""

import collections
import hashlib
import html
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstone.llm import alignment, html_text, merkle, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- 11 ---
def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    """Levels of a tree, from the leaves up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        out += run[: i % 16] + run[i % 16 + 1 :]
        i //= 16
    return "".join(out)


def plain_manifest(rows):
    """(id, leaf, subroot, root, proof, group) of rows (group, id, leaf), sorted."""
    groups = collections.defaultdict(list)
    for g, i, leaf in rows:
        groups[g].append((i is not None, i or 0, leaf, i))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = plain_tree([trees[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for i, x in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            out.append((x[3], x[2], trees[g][-1][0], top[-1][0], siblings(trees[g], i) + siblings(top, at), g))
    return sorted(out, key=repr)


def manifest_of(spark, rows, schema="source string, doc_id long, leaf string"):
    return merkle.merkle_manifest(spark.createDataFrame(rows, schema))


@pytest.mark.parametrize("case", ["mixed", "one", "many groups", "several passes", "repeats"])
def test_manifest(spark, case):
    rng = random.Random(case)
    leaf = lambda: sha(str(rng.random()))
    if case == "mixed":  # negative, far apart, null and repeated ids, null, empty and unusual groups
        ids = [None, None, -(1 << 63), (1 << 63) - 1, -1, 0, 0, 5, *(rng.randint(-(1 << 62), 1 << 62) for _ in range(40)), *range(1000, 1100)]
        rows = [(rng.choice([None, "", "a", "é", "\x01", "z" * 300]), i, leaf()) for i in ids * 2]
    elif case == "one":
        rows = [("only", 7, leaf())]
    elif case == "many groups":
        rows = [(f"g{i}", i, leaf()) for i in range(300)]
    elif case == "several passes":  # several arrays of slots, some of them full
        rows = [("hot" if i % 10 else "other", i * 37, leaf()) for i in range(9300)] + [("full", i, leaf()) for i in range(4096)]
    else:
        same = leaf()
        rows = [("a", 3, same)] * 500 + [("a", 3, leaf()) for _ in range(200)] + [("a", 4, leaf()), ("b", 3, same), ("a", None, same), ("a", None, same)]
    found = manifest_of(spark, rows)
    got = found.proofs.collect()
    want = plain_manifest(rows)
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.source) for r in got], key=repr) == want
    assert all(r.folded_root == found.root == merkle.fold(r.leaf, r.slot, r.n_leaves, r.grp_slot, r.n_groups, r.proof) for r in got)
    assert len({(r.source, r.slot) for r in got}) == len(rows)


def test_manifest_claims_and_empty(spark):
    rows = [("s", i, sha(str(i)), sha("other") if i == 3 else sha("4") if i == 4 else None) for i in range(40)]
    got = merkle.merkle_manifest(spark.createDataFrame(rows, "source string, doc_id long, leaf string, claim string"), claim="claim").proofs.collect()
    assert [r.doc_id for r in got if r.folded_root != r.root] == [3]
    empty = manifest_of(spark, [])
    assert empty.root is None and empty.proofs.count() == 0 and empty.groups.count() == 0


def test_manifest_query_odd_rows(spark, tmp_path):
    rows = [(None,) * 8, (1, None, "en", "s", 3, "x", 1, "y"), (2, "Ä B c", None, None, None, "x", 1, "y"), (5, "ABC" * 100_000, "de", "", 0, "x", 1, "y"), (2, "Ä B c", None, None, None, "x", 1, "y"), *((i, f"Text {i}", "en", "s", i, "x", 1, "y") for i in range(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, leaf string, k int, root string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).collect()
    leaves = [(r[3], r[0], plain_leaf(r[0], r[3], r[2], r[4], r[1])) for r in rows]
    want = plain_manifest(leaves)
    assert sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got], key=repr) == sorted([(*w[:4], sha(w[4])) for w in want], key=repr)
    changed = {r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] and re.search("[A-Z]", r[1])}
    assert changed and {r.doc_id for r in got if not r.verified} == changed
    assert all(r.verified == (r.folded_root == r.root) for r in got)


# --- 12 ---
def main_text(page):
    return "\n".join(html_text.main_lines(html_text.lines_of(page)))


def test_given_pages(spark):
    got = {r.page_id: r for r in queries.QUERIES["op12_html_extraction"](spark, DATA).collect()}
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        article = re.search("(?s)<article>(.*)</article>", p.html)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert got[p.page_id].text == "\n".join(b for b in blocks if b) and got[p.page_id].n_chars == len(got[p.page_id].text)


LINE = "A paragraph of the article, with enough words in it to look like running text, number {}."
BODY = "".join(f"<p>{LINE.format(i)}</p>" for i in range(4))
AROUND = [
    '<nav><ul><li><a href="/">Home</a></li></ul></nav>', '<div class="site-header">My site <a href="/">home</a></div>', '<div id="sidebar"><p>Read this other long thing, which isn\'t the article, and has many words too.</p></div>',
    '<div class="ad-slot">Buy now, a long advert with really many words to fill a line of its own.</div>', '<div class="cookie-notice">We use cookies, and say so at some length here.</div>', "<script>var a = '<p>no</p>';</script><style>p{}</style>",
    '<form action="/s"><label>Search here</label><input name="q"></form>', "<footer><p>&copy; all rights reserved, in a line of some length at the foot of the page.</p></footer>",
    '<section id="comments"><article class="comment"><p>I read it all, and here is a long comment about what I think of this article.</p></article></section>', '<ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul>',
]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>', "<div><div>{}</div></div>"])
def test_pages_of_several_shapes(wrap):
    rng = random.Random(wrap)
    want = ["Head", *(LINE.format(i) for i in range(4))]
    for _ in range(20):
        around = rng.sample(AROUND, len(AROUND))
        k = rng.randint(0, len(around))
        page = "<html><head><title>T</title></head><body>" + "".join(around[:k]) + wrap.format(f"<h1>Head</h1>{BODY}") + "".join(around[k:])
        assert main_text(page).split("\n") == want, page


def test_blocks_and_references():
    page = "<article><h1>A &amp; B</h1><p>one\n two<br>three&nbsp;four &#8364; &lt;x&gt;<b>bold</b>er<p>Be.<ul><li>first<li>second</ul><table><tr><td>l<td>r</table><blockquote>said</blockquote><!-- no --><p hidden>no</p>loose text"
    assert main_text(page) == "A & B\none two three four € <x>bolder\nBe.\nfirst\nsecond\nl\nr\nsaid\nloose text"
    assert main_text('<form id="f"><article><p>In a form of the whole page</p></article></form>') == "In a form of the whole page"
    assert main_text("<article><p>text with 1 < 2 and <p>more") == "text with 1 < 2 and\nmore"
    assert main_text("<article><p>one<!-- open <p>two") == "one"
    for nothing in ("", "<nav>x</nav>", "<script>x", "<!--", "<", "<<<>>>", "</p></p>", "<a <b <c"):
        assert isinstance(main_text(nothing), str)


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x" + "</span>" * 50_000, "<article>x" + "<!-- " * 100_000, "<a " * 100_000, '<a b="' * 50_000, "<![x " * 50_000 + ">", "<table><td>" * 20_000 + "</div>" * 20_000, "<p>" * 100_000, "&" * 300_000, "<article><p>" + "word " * 500_000])
def test_broken_and_long_pages_take_linear_time(page):
    began = time.thread_time()
    main_text(page)
    assert time.thread_time() - began < 15


def test_extract_odd_tables(spark):
    rows = [(1, None, "a", "t"), (2, "", "b", "t"), (3, "<p>x</p>", None, "t"), (3, "<p>x</p>", None, "t"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, `row.url` string, text string")
    got = sorted(((r["page_id"] or 0, r["text"], r["row.url"]) for r in html_text.extract(pages).collect()), key=repr)
    assert got == sorted([(1, "", "a"), (2, "", "b"), (3, "x", None), (3, "x", None), (0, "", None)], key=repr)
    assert html_text.extract(pages.limit(0)).collect() == []


# --- 13 ---
PIECES = ["a", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "\xa0", "é", "漢字", "word", "don't", "'s", "123", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "▁", "!!", "...", " ", "﻿", "\x00", "The", "x" * 120, "😀", "ﬁ", "\r\n", "\x1f"]


def plain_alignment(texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups of each text, as the contract says."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {v: k for k, v in alignment._byte_letters().items()}
    docs, counts = [], collections.Counter()
    for t in texts:
        if not t:
            docs.append(None)
            continue
        x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        left = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
        right = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not b"".join(left) == b"".join(right) == (" " + t).encode():
            docs.append(None)
            continue
        ends = [np.cumsum([len(z) for z in side]).tolist() for side in (left, right)]
        links = [(x[i], y[j]) for i, e in enumerate(ends[0]) for j, f in enumerate(ends[1]) if e == f]
        cuts = [0, *sorted(set(ends[0]) & set(ends[1]))]
        ids = lambda z, e, lo, hi: ",".join(str(i) for i, at in zip(z, e) if lo < at <= hi)
        docs.append((len(x), len(y), links, [ids(x, ends[0], lo, hi) + "|" + ids(y, ends[1], lo, hi) for lo, hi in zip(cuts, cuts[1:])]))
        counts.update(links)
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, links, groups = d
            out.append((n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("most_pairs", [1_000_000, 0])
def test_alignment(spark, most_pairs):
    rng = random.Random(5)
    given = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 400").orderBy("doc_id").limit(40).collect()]
    odd = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    texts = [None, "", " ", *given, *given[:5], *odd, "one two " * 3000, "z" * 20_000]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, row string, n_a int").repartition(3)
    got = {r.doc_id: r for r in alignment.align(docs, A, B, most_pairs=most_pairs).collect()}
    for i, want in enumerate(plain_alignment(texts)):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == want, texts[i]
    assert got[0].row == "x"
    fewer = texts[1::2]  # workers that know other corpora
    some = alignment.align(docs.where("doc_id % 2 = 1"), A, B, most_pairs=most_pairs).collect()
    assert sorted((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in some) == sorted(plain_alignment(fewer))
    assert alignment.align(docs.limit(0), A, B).collect() == []


def test_aligner_forgets():
    """A worker that keeps few segments gives the same."""
    texts = [f"word{i} and more{i % 7}, again" for i in range(300)]
    small, large = alignment.Aligner(A, B, most=10), alignment.Aligner(A, B)
    for t in texts:
        if small.full:
            small.clear()
        (x, _), (y, _) = small.place([t]), large.place([t])
        assert small.links(x).tolist() == large.links(y).tolist() and ";".join(small.groups[s] for s in x) == ";".join(large.groups[s] for s in y)


@pytest.mark.parametrize("n", [0, 1, 2, 77, 30_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 40, n))
    levels = alignment.build_hash(keys)
    assert (np.sort(alignment.hash_index(levels, keys)) == np.arange(len(keys))).all()
    keys = keys[np.argsort(alignment.hash_index(levels, keys))]
    table = alignment.Table([(0, keys.tobytes(), (keys % 97).tobytes())], 1, np.zeros(1, np.int64))
    assert (table[keys] == keys % 97).all()
    with pytest.raises(KeyError):
        table[np.array([1 << 41])]


def test_counts_over_several_buckets(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(p), int(n)) for p, n in zip(rng.integers(0, 3000, 8000), rng.integers(1, 9, 8000))]
    want = collections.Counter()
    for p, n in rows:
        want[p] += n
    monkeypatch.setattr(alignment, "BUCKET", 500)
    table = alignment.counted(spark.createDataFrame(rows, "pair long, n long").repartition(5), len(want)).collect()
    got = {k: n for r in table for k, n in zip(np.frombuffer(r["keys"], np.int64).tolist(), np.frombuffer(r.counts, np.int64).tolist())}
    assert len(table) > 3 and got == want
