"""Relations in text: places, contexts and both ends, against plain versions."""

import re

import pytest

from tidemark.operators import mentions

TEXTS = [
    (1, "Acme Corp is a supplier to Beta Industries. Later Acme acquired Gamma, and Beta Industries competes with Delta."),
    (2, "SUPPLIERS OF Supplier of customers for customer of"), (3, None), (4, ""), (5, "x" * 200 + " partnership with " + "y" * 300), (6, "é acquisition of ñandú licenses from ß"),
    (7, "distributes for manufacturer for joint venture with joint venture with"), (7, "distributes for manufacturer for joint venture with joint venture with"), (None, "Beta partnered with Acme"), (8, "acquiring acquiring"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in TEXTS], "doc_id long, text string, rel string").repartition(4)


def plain(texts, phrases):
    out = []
    for i, t in texts:
        for p, rel in phrases:
            out += [(i, rel, m.start(), m.end(), t[max(0, m.start() - 50) : m.start()], t[m.end() : m.end() + 100], t[max(0, m.start() - 50) : m.end() + 100].strip()) for m in re.finditer(p, t or "", re.IGNORECASE | re.ASCII)]
    return sorted(map(str, out))


def test_places_and_contexts(docs):
    assert sorted(str(tuple(r)) for r in mentions.mentioned(docs).collect()) == plain(TEXTS, mentions.PHRASES)


def test_phrases_may_overlap(docs):
    phrases = (("joint venture", "a"), ("venture with joint", "b"), ("with", "c"))
    got = mentions.mentioned(docs, phrases).collect()
    assert sorted(str(tuple(r)) for r in got) == plain(TEXTS, phrases) and {r.rel for r in got} == {"a", "b", "c"}
    spans = [(r.start, r.stop) for r in got if r.doc_id == 7 and r.rel in "ab"]
    assert any(a < c < b for a, b in spans for c, _ in spans)


ALIASES = [("acme", "E:acme"), ("Acme Corp", "E:acme"), ("beta industries", "E:beta"), ("Beta", "E:other"), ("GAMMA", "E:gamma"), ("delta", "E:delta"), ("delta", "E:z"), ("ñandú", "E:n"), (None, "E:x"), ("y", None)]


def test_both_ends(spark, docs):
    aliases = spark.createDataFrame(ALIASES, "alias string, entity string")
    got = mentions.resolved(mentions.mentioned(docs), aliases).collect()
    assert len(got) == len(plain(TEXTS, mentions.PHRASES))  # each place stays, repeated rows as well
    ends = {(r.doc_id, r.rel): (r.src, r.dst) for r in got}
    assert ends[1, "supplier_of"] == ("E:acme", "E:beta")
    assert ends[1, "acquired"] == ("E:acme", "E:gamma")
    assert ends[1, "competes_with"] == ("E:beta", "E:delta")  # the longer of two names that end there; of two entities the first
    assert ends[None, "partner_of"] == ("E:other", "E:acme")
    assert ends[6, "acquired"] == (None, "E:n") and ends[6, "licenses_to"] == ("E:n", None)
    assert ends[5, "partner_of"] == (None, None)
    rows = {(r.src, r.dst, r.rel): (r.n, r.first_doc) for r in mentions.relations(mentions.resolved(mentions.mentioned(docs), aliases)).collect()}
    assert rows == {("E:acme", "E:beta", "supplier_of"): (1, 1), ("E:acme", "E:gamma", "acquired"): (1, 1), ("E:beta", "E:delta", "competes_with"): (1, 1), ("E:other", "E:acme", "partner_of"): (1, None)}


@pytest.mark.parametrize("places", [1, 3, 8192])
def test_places_in_blocks_carry_their_own_columns_alone(spark, docs, monkeypatch, places):
    """However the places are dealt, and without the evidence (ends were found by a join on it, a row for each run of words)."""
    monkeypatch.setattr(mentions, "PLACES", places)
    aliases = spark.createDataFrame(ALIASES, "alias string, entity string")
    got = mentions.resolved(mentions.mentioned(docs).select("doc_id", "rel", "start", "before", "after"), aliases)
    assert got.columns == ["doc_id", "rel", "start", "before", "after", "src", "dst"]
    rows = sorted(str((r.doc_id, r.rel, r.src, r.dst)) for r in got.collect())
    assert len(rows) == len(plain(TEXTS, mentions.PHRASES))
    linked = {(1, "supplier_of", "E:acme", "E:beta"), (1, "acquired", "E:acme", "E:gamma"), (1, "competes_with", "E:beta", "E:delta"), (None, "partner_of", "E:other", "E:acme"), (6, "acquired", None, "E:n"), (6, "licenses_to", "E:n", None)}
    assert {r for r in rows if "E:" in r} == set(map(str, linked))


def test_names_have_the_lengths_of_aliases(spark):
    row = spark.createDataFrame([(["a", "b", "c"], [1, 3], [2]), ([], [1], [2])], "w array<string>, s array<int>, t array<int>")
    got = row.select(mentions.names(row.w, row.s).alias("x"), mentions.names(row.w, row.t).alias("y")).collect()
    assert got[0].x == ["a", "b", "c", "a b c"] and got[0].y == ["a b", "b c"] and got[1].x == got[1].y == []


def test_symbols(spark):
    texts = [(1, "Buy $ABC and shares XYZ, not $TOOLONG or the CEO; ticker GDP"), (2, "NYSE   QQ $ABC $ABC"), (3, None), (4, "stock abc")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert sorted((r.doc_id, r.symbol) for r in mentions.symbols(docs).collect()) == [(1, "ABC"), (1, "XYZ"), (2, "ABC"), (2, "QQ")]
    known = spark.createDataFrame([("abc",), ("abc",)], "symbol string")
    assert sorted((r.doc_id, r.symbol) for r in mentions.symbols(docs, known).collect()) == [(1, "ABC"), (2, "ABC")]


def test_known_relations_chains_and_ranks(spark):
    found = spark.createDataFrame([("a", "b", "supplier_of", 3, 1), ("b", "c", "supplier_of", 1, 2), ("c", "a", "supplier_of", 1, 2), ("a", "c", "acquired", 9, 4)], "src string, dst string, rel string, n long, first_doc long")
    known = spark.createDataFrame([("a", "b", "supplier_of"), ("x", "y", "supplier_of"), ("x", "y", "supplier_of")], "src string, dst string, rel string")
    got = {(r.src, r.dst, r.rel): (r.n, r.known, r.read) for r in mentions.with_known(found, known).collect()}
    assert got["a", "b", "supplier_of"] == (3, True, True) and got["x", "y", "supplier_of"] == (0, True, False) and got["a", "c", "acquired"] == (9, False, True) and len(got) == 5
    assert {(r.src, r.tier): r.n_names for r in mentions.chain(found).collect()} == {(s, t): 1 for s in "abc" for t in (1, 2)}
    assert [(r.rel, r.src, r["rank"]) for r in mentions.ranked(found, 1).orderBy("rel").collect()] == [("acquired", "a", 1), ("supplier_of", "a", 1)]


def test_empty(spark, docs):
    aliases = spark.createDataFrame([], "alias string, entity string")
    assert mentions.mentioned(docs.limit(0)).count() == mentions.relations(mentions.resolved(mentions.mentioned(docs), aliases)).count() == 0


def nearest(own, entities, sizes, last):
    for i in range(len(own), 0, -1) if last else range(len(own)):
        for k in sizes:
            run = own[max(i - k, 0) : i] if last else own[i : i + k]
            if len(run) == k and (entity := entities.get(" ".join(run))) is not None:
                return entity
    return None


@pytest.mark.parametrize("seed", range(4))
def test_nearest_names_equal_a_plain_search(spark, seed):
    import random

    rng = random.Random(seed)
    word = lambda: rng.choice("abcdef")
    said = lambda n: " ".join(word() for _ in range(rng.randint(0, n)))
    known = {" ".join(word() for _ in range(rng.randint(1, 4))): None for _ in range(rng.choice((0, 1, 12)))}
    known = {a: f"E{a}" for a in known}
    rows = [(rng.choice((None, k % 9)), "rel", k, said(6), rng.choice((None, said(9)))) for k in range(150)]
    found = spark.createDataFrame(rows, "doc_id long, rel string, start int, before string, after string").repartition(3)
    aliases = spark.createDataFrame(list(known.items()), "alias string, entity string")
    got = sorted(map(str, (tuple(r) for r in mentions.resolved(found, aliases).collect())))
    short, sizes = {a: e for a, e in known.items() if a.count(" ") < mentions.NAME_WORDS}, range(mentions.NAME_WORDS, 0, -1)
    assert got == sorted(str((*r, nearest(r[3].split(), short, sizes, True), nearest((r[4] or "").split(), short, sizes, False))) for r in rows)


def test_places_are_made_once(spark):
    from pyspark.sql import functions as F

    made = spark.sparkContext.accumulator(0)

    def scan(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    schema = "doc_id long, rel string, start int, before string, after string"
    found = spark.createDataFrame([(k, "rel", k, "acme is", "to beta") for k in range(40)], schema).mapInArrow(scan, schema)
    aliases = spark.createDataFrame(ALIASES, "alias string, entity string")
    assert mentions.resolved(found, aliases, spark.range(1).select(F.lit(40).alias("rows"))).count() == 40
    assert made.value == 40


def test_filings_are_read_once_for_the_chain(spark):
    from tidemark.plans import keeping

    plan = keeping.chain(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "InArrow" not in plan and "lineitem" not in plan
