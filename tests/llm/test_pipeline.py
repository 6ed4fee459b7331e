"""The corpus pipeline, whole and stage by stage."""

import itertools
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dwellspark.llm import near_copies, queries

SMALL = "/root/testdata/sf0.001"


def test_run_equals_its_stages(spark):
    docs = queries.table(spark, SMALL, "documents")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SMALL)
        assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in out} == ids
    quality = {r.doc_id: r.quality for r in queries.table(spark, SMALL, "labels").collect()}
    good = [d for d, q in quality.items() if q == 1]
    assert len(set(good) & ids) > 0.6 * len(good)


def test_stages_take_odd_rows(spark):
    rows = [(1, None, "en", "s", None, 5), (None, "some words", None, None, 3, 6), (2, "", "en", "s", 0, 7), (2, "", "en", "s", 0, 7), (3, "w " * 50_000, "en", "s", 1, 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns
        out.collect()
        assert stage(spark, docs.filter("false"), SMALL).count() == 0
    name, packing = corpus_pipeline.STAGES[-1]
    assert name == "packing"
    pieces = packing(spark, docs, SMALL).collect()
    tokens = {}
    for r in pieces:
        tokens.setdefault((r.doc_id, r.doc_tokens), []).append(r.length)
    assert sum(map(sum, tokens.values())) == sum(n * sum(x == n for x in [r.doc_tokens for r in pieces if r.start == 0]) for n in {r.doc_tokens for r in pieces})
    assert {r.doc_id for r in pieces} == {1, None, 2, 3} and max(r.doc_tokens for r in pieces) > 50_000 and packing(spark, docs.filter("false"), SMALL).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SMALL)
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in df.collect())


def test_held_out_rows_are_a_fifth(spark):
    docs = queries.table(spark, SMALL, "documents").select("doc_id", queries.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in docs)
    assert F is not None


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def least_of_groups(texts):
    """The least id that each id reaches over pairs of similarity 0.8 or more."""
    sets, parent = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if x == y or (x and y and len(x & y) / len(x | y) >= 0.8):
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    return {i: root(i) for i in texts}


def edited(words, n, rng):
    words = list(words)
    for at in rng.choice(len(words), n, replace=False):
        words[at] = f"edit{rng.integers(1 << 40)}"
    return " ".join(words)


def test_near_copies_of_tables_with_clashing_columns(spark):
    rows = [(1, "a b c d e f g", 7, "x", 0), (2, "A b  c d e f g", 8, "y", 1), (3, None, 9, None, 2), (None, "", 9, None, 2), (4, "other words than those", 1, "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, Node int, component_id string, bands int")
    assert {(r.doc_id, r.component_id) for r in near_copies.near_copies(docs).collect()} == {(1, 1), (2, 1), (3, 3), (None, 3), (4, 4)}
    kept = near_copies.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    assert near_copies.near_copies(docs.filter("false")).count() == 0


def test_near_copies_of_a_given_table_equal_brute_force(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == least_of_groups(texts)


@pytest.mark.parametrize("crowd", [32, 3])
def test_near_copies_equal_brute_force(spark, crowd):
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    texts = [r.text for r in queries.table(spark, SMALL, "documents").limit(150).collect()] + [None, "", " \n", "One two", "one  TWO", "one three"]
    for n, edits, copies in [(300, (1, 2, 4, 5, 6, 7, 9, 12), 3), (60, (1, 2), 4), (1000, (5, 15, 20, 22, 30), 2)]:
        for _ in range(4):
            base = word(n)
            texts += [" ".join(base), *[edited(base, k, rng) for k in edits for _ in range(copies)]]
    chain = word(200)  # each step is a near copy of the last, the ends have nothing in common
    texts += [" ".join(chain[i:] + word(i)) for i in range(0, 60, 4)]
    page = word(300)  # many texts of one template that are no near copies of each other
    texts += [" ".join(page + word(90)) for _ in range(60)]
    rows = dict(enumerate(texts))
    docs = spark.createDataFrame([(int(i), t) for i, t in rows.items()], "doc_id bigint, text string")
    want = least_of_groups(rows)
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs, crowd=crowd).collect()} == want
    if crowd == near_copies.CROWD:
        assert sorted(r.doc_id for r in corpus_pipeline.deduplicate(spark, docs, SMALL).collect()) == sorted(set(want.values()))


def test_near_copies_come_from_fingerprints_first(spark):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 50_000, 20_000)]
    texts = {1: " ".join(base), 2: edited(base, 1, rng), 3: " ".join(f"x{x}" for x in rng.integers(0, 50_000, 300)), 4: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    made = near_copies.add_columns(docs, near_copies.COLUMNS, ["doc_id"], lambda b: near_copies.measured(b["text"]), lambda b: iter([b])).persist()
    of = {r.doc_id: r for r in made.collect()}
    assert bin((of[1].simhash ^ of[2].simhash) % 2**64).count("1") <= 2
    alone = made.withColumn("bands", F.array("node"))  # no band is shared
    found = near_copies.links(alone, lambda nodes: near_copies.sets_of(docs, nodes)).collect()
    assert [{r.a, r.b} for r in found] == [{of[1].node, of[2].node}]
