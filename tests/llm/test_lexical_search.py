"""Ranked lexical search against a plain version, and what its bounds leave out."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_llm import DIR, docs, lower, real  # noqa: F401
from tidemark.llm import lexical_search as ls


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))


def plain(rows, queries, k):
    counted = [(i, Counter(terms(t))) for i, t in rows if terms(t)]
    n, words = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    items = {}
    for item, text in queries:
        items.setdefault(item, set()).update(terms(text))
    found = []
    for item, asked in items.items():
        scored = []
        for i, c in counted:
            m = 10 + (90 * c.total() * n) // words
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in asked & c.keys())
            if score > 0:
                scored.append((-score, i is None, i or 0))
        found += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return found


def ranked(df):
    return [tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()]


QUERIES = [(1, "one two three"), (1, "LINE here"), (2, None), (3, ""), (4, " . "), (None, "é" * 300 + " w7919"), (5, "a1 A2 a3 x x x"), (6, "password MIT license"), (7, "absent words")]


@pytest.mark.parametrize("k, part_bytes", [(10, ls.PART_BYTES), (2, 40)])
def test_search_of_awkward_rows(spark, docs, k, part_bytes):  # noqa: F811
    asked = spark.createDataFrame([(i, t, 1.5) for i, t in QUERIES], "item_id long, text string, doc_id double")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = ranked(ls.search(ls.indexed(docs), asked, k, part_bytes))
    assert sorted(map(str, got)) == sorted(map(str, plain(rows, QUERIES, k)))


def test_search_of_real_rows_and_string_ids(spark, real):  # noqa: F811
    items = [(f"q{r.item_id}", r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    got = ranked(ls.search(ls.indexed(real), spark.createDataFrame(items, "item_id string, text string")))
    assert sorted(got) == sorted(plain([(r.doc_id, r.text) for r in real.collect()], items, 10))


def test_search_of_empty_tables(spark, docs):  # noqa: F811
    none = spark.createDataFrame([], "item_id long, text string")
    empty = ls.indexed(docs.limit(0))
    assert (empty.n_docs, empty.n_words) == (0, 0)
    assert ranked(ls.search(empty, spark.createDataFrame(QUERIES, "item_id long, text string"))) == []
    assert ranked(ls.search(ls.indexed(docs), none)) == []


def made(rng, n_blocks, common):
    """Blocks of 8 documents of 30 words; each block has words of its own beside common ones."""
    documents, blocks, at = [], [], 0
    for b in range(n_blocks):
        words = [np.concatenate([rng.integers(0, common, 20), rng.integers(1000 + 50 * b, 1050 + 50 * b, 10)]).astype(np.uint64) for _ in range(8)]
        blocks.append((at, words))
        documents += words
        at += 8
    n_words = sum(map(len, documents))
    df = Counter(t for d in documents for t in set(d.tolist()))
    packed = []
    for at, words in blocks:
        found, index = ls.forward(np.arange(at, at + 8), np.zeros(8, bool), np.concatenate(words), np.arange(0, 241, 30))
        most, impact = np.zeros(len(found), np.int64), index.impacts(len(documents), n_words)
        np.maximum.at(most, index.term, impact)
        packed.append((found.tobytes(), most.astype("<u4").tobytes(), at, index.pack()))
    return documents, n_words, df, packed


def test_blocks_below_the_threshold_are_never_unpacked():
    rng = np.random.default_rng(5)
    documents, n_words, df, packed = made(rng, 100, 20)
    asked = [[3, 1000, 1001, 1002], [5, 1000 + 50 * 40, 1001 + 50 * 40], [1, 2]]
    own = np.unique(np.concatenate(asked).astype(np.uint64))
    first = np.cumsum([0, *map(len, asked)])
    queries = ls.Queries(own, np.array([ls.weight(len(documents), df[t]) for t in own.tolist()]), first, np.concatenate([np.searchsorted(own, np.array(a, np.uint64)) for a in asked]))
    whole, cut = ls.Search(queries, len(documents), n_words, 5), ls.Search(queries, len(documents), n_words, 5)
    blocks = [ls.Block(queries, *p) for p in packed]
    whole.add(blocks)
    for a in range(0, 100, 7):  # in batches the same documents are found
        cut.add([ls.Block(queries, *p) for p in packed[a : a + 7]])
    assert whole.found == cut.found
    scores = [[sum(int(w) * (10**9 * c // (1000 * c + 8 * (10 + 90 * 30 * len(documents) // n_words))) for t, w in zip(own.tolist(), queries.weight) if t in a and (c := d.tolist().count(t))) for d in documents] for a in asked]
    assert [[(-f.score, f.doc_id) for f in found] for found in whole.found] == [[(s[i], i) for i in sorted(range(len(s)), key=lambda i: (-s[i], i))[:5]] for s in scores]
    for i in (0, 1):  # rare words: one block decides
        alone = ls.Search(ls.Queries(own, queries.weight, np.array([0, len(asked[i])]), queries.term[first[i] : first[i + 1]]), len(documents), n_words, 5)
        alone.add([ls.Block(alone.queries, *p) for p in packed])
        assert alone.scored <= 3


def test_equal_scores_take_the_smallest_ids():
    words = np.tile(np.array([1, 2, 3], np.uint64), 8)
    packed = []
    for at in (80, 0, 40, 16):
        found, index = ls.forward(np.arange(at, at + 8), np.zeros(8, bool), words, np.arange(0, 25, 3))
        packed.append((found.tobytes(), np.full(3, index.impacts(32, 96).max()).astype("<u4").tobytes(), at, index.pack()))
    queries = ls.Queries(np.array([2], np.uint64), np.array([7]), np.array([0, 1]), np.array([0]))
    state = ls.Search(queries, 32, 96, 10)
    state.add([ls.Block(queries, *p) for p in packed])
    assert [f.doc_id for f in state.found[0]] == [0, 1, 2, 3, 4, 5, 6, 7, 16, 17]
    state.add([ls.Block(queries, *p) for p in packed[:1]])
    assert state.scored == 4  # the later one can only tie, with larger ids
