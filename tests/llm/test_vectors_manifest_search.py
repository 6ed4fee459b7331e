"""Embedding near-duplicates, the Merkle manifest and ranked lexical search against brute force."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellspark.llm import embedding_links, lexical_search, merkle, queries

SMALL = "/root/testdata/sf0.001"


# 11 --------------------------------------------------------------------------------------


def brute_links(rows, cosine=0.95):
    """(id, links, component, kept) of rows (id, vector), in order."""
    units = []
    for _, v in rows:
        ok = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, float) / np.abs(v).max() if ok else None
        units.append(x / np.linalg.norm(x) if ok else None)
    n, at = len(rows), list(range(len(rows)))
    linked = [[j for j in at if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine] for i in at]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(ids, default=None)
        out.append((rows[i][0], len(linked[i]), component, rows[i][0] == component))
    return out


def planted(n, groups, rng, spread=0.15, size=32):
    centres = rng.normal(size=(groups, size))
    return [(i, [float(x) for x in np.float32(centres[i % groups] + spread * rng.normal(size=size) * (i >= groups))]) for i in range(n)]


def shown(df):
    return sorted([(r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()], key=str)


def test_links_equal_all_pairs_also_in_parts(spark):
    rng = np.random.default_rng(5)
    rows = planted(300, 40, rng) + planted(90, 1, rng, 0.05)[1:]
    rows = [(1000 - i, v) for i, (_, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5)
    want = sorted(brute_links(rows), key=str)
    assert max(r[1] for r in want) > 80
    # a group larger than a part, and groups that end in any batch
    for part in (7, 2048):
        got = shown(embedding_links.near_vectors(df, part=part))
        assert got == want


def test_chains_join_what_no_pair_does(spark):
    turn = [math.acos(0.96) * i for i in range(12)]
    rows = [(i * 7 % 12, [math.cos(t), math.sin(t), 0.0]) for i, t in enumerate(turn)]
    got = shown(embedding_links.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), recall=0.9999999))
    assert got == sorted(brute_links(rows), key=str) and {r[2] for r in got} == {0}


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (None, [3.0, 0.01]), (None, [0.0, 5.0]), (4, None), (5, []), (6, [0.0, 0.0]), (6, [0.0, 0.0]),
        (7, [1.0, None]), (8, [1.0, float("nan")]), (9, [float("inf"), 1.0]), (10, [-1.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [1e200, 0.0]), (13, [-0.0, 2.0]), (14, [1e-300, 0.0]),
    ]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, Node int, component_id string")
    assert shown(embedding_links.near_vectors(df)) == sorted(brute_links(rows), key=str)
    assert embedding_links.near_vectors(df.filter("false")).count() == 0
    assert embedding_links.near_vectors(df.filter("vec_id = 4")).collect()[0][1:] == (0, 4, True)


def test_recall_at_the_least_cosine(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        x, y = rng.normal(size=(2, 64))
        x /= np.linalg.norm(x)
        y -= (x @ y) * x
        y /= np.linalg.norm(y)
        rows += [(2 * i, x.tolist()), (2 * i + 1, (0.9501 * x + math.sqrt(1 - 0.9501**2) * y).tolist())]
    got = embedding_links.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    assert got.filter("n_links = 1 AND component_id = vec_id - vec_id % 2").count() >= 0.97 * 800


def test_tables_follow_the_number_of_vectors():
    for n in (10, 10_000, 10**9):
        bits, tables = embedding_links.tables_for(n)
        agree = (1 - math.acos(0.95) / math.pi) ** bits
        assert 1 - (1 - agree) ** tables >= embedding_links.RECALL and 2**bits >= n / 2


# 12 --------------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(leaves):
    """(root, [[(before, after), ...] per leaf])."""
    nodes, members, paths = list(leaves), [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(nodes) > 1:
        above, owners = [], []
        for a in range(0, len(nodes), 3):
            run = nodes[a : a + 3]
            for k, own in enumerate(members[a : a + 3]):
                for i in own:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(sha(*run))
            owners.append([i for own in members[a : a + 3] for i in own])
        nodes, members = above, owners
    return nodes[0], paths


def brute_manifest(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((r[0], sha(*map(part, r))))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    roots, trees = [], {}
    for s in sources:
        own = sorted(by_source[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        root, paths = climb([x[1] for x in own])
        roots.append(root)
        trees[s] = (own, root, paths)
    root, ups = climb(roots)
    return sorted([(i, s, d, trees[s][1], root, p + up) for s, up in zip(sources, ups) for (i, d), p in zip(trees[s][0], trees[s][2])], key=str)


def manifest_rows(df, **options):
    fields = {c: F.col(c) for c in merkle.FIELDS}
    got = merkle.manifest(df, merkle.leaf(**fields), **options).collect()
    return sorted([(r.doc_id, r.source, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in got], key=str)


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, slot string, Root int"


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_equals_brute_force(spark, levels):
    sizes = {"one": 1, "two": 2, "three": 3, "four": 4, "nine": 9, "ten": 10, "many": 100, "ünï": 28, None: 5, "": 7}
    rows = [(i * 37 % 1009, s, "en", i, f"text {i}\nof {s}") for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(7)
    assert manifest_rows(df, levels=levels) == brute_manifest(rows)


def test_manifest_of_odd_rows(spark):
    rows = [(None, "a", None, None, None), (None, "a", None, None, ""), (1, "a", "x", 1, "same"), (1, "a", "x", 1, "same"), (1, "a", "x", 1, "same"), (1, None, "é日", -5, "é\n日" * 50_000), (2, "", "", 0, "")]
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    assert manifest_rows(df) == brute_manifest(rows)
    assert manifest_rows(df.filter("false")) == []
    one = manifest_rows(df.filter("doc_id = 2"))
    assert one[0][2] == one[0][3] == one[0][4] and one[0][5] == []


def test_a_changed_row_fails_its_proof(spark):
    out = queries.op12_merkle_manifest(spark, SMALL)
    docs = queries.table(spark, SMALL, "documents").select("doc_id", "text")
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.coalesce(F.contains("text", F.lit("\n")), F.lit(False))
    both = out.join(docs, "doc_id").withColumn("changed", changed)
    assert both.filter("verified = changed OR (folded_root = root) = changed").count() == 0
    assert both.filter("changed").count() > 10 < both.filter("NOT changed").count()
    assert out.select("root").distinct().count() == 1


# 13 --------------------------------------------------------------------------------------


def words(text):
    lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute_search(docs, items, k):
    counts = [(i, Counter(words(t))) for i, t in docs]
    n_docs, length = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counts:
            m = 75 + 25 * sum(c.values()) * n_docs // max(1, length)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted([tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()], key=str)


@pytest.mark.parametrize("limits", [{}, {"block_terms": 20}, {"block_items": 3}])
def test_search_equals_brute_force(spark, limits, monkeypatch):
    # small trees with many branches; workers are forked, so a task takes these values along
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "日本", "X9"]
    draw = lambda n: " ".join(vocabulary[i] for i in np.minimum(rng.zipf(1.4, n) - 1, 62))
    docs = [(i, draw(int(rng.integers(0, 40)))) for i in range(700)] + [(900 + i, "copied w1 w2 w40") for i in range(60)]
    items = [(i, draw(12)) for i in range(8)] + [(50, "w40 copied copied"), (51, "absent"), (52, None)]
    got = lexical_search.top_documents(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string"), k=20, **limits)
    assert found(got) == brute_search(docs, items, 20)


def test_a_tree_bounds_every_score_and_finds_the_best():
    rng = np.random.default_rng(4)
    terms, docs = 50, 3000
    lists = [np.unique(np.minimum(rng.zipf(1.3, int(rng.integers(1, 15))) - 1, terms - 1)) for _ in range(docs)]
    of = np.repeat(np.arange(docs), [len(x) for x in lists])
    ranks, times = np.concatenate(lists).astype(np.int32), rng.integers(1, 9, len(of))
    m = rng.integers(75, 300, docs)
    tree = lexical_search.Tree(np.arange(docs).astype(object), m, of, ranks, times, terms)
    assert 20 < len(tree.first) < 6 * docs / lexical_search.RANGE_DOCS
    weights = rng.integers(1, 9000, 6)
    asked = np.array([0, 3, 7, 11, 20, 33])
    by_rank = np.zeros(terms, np.int64)
    by_rank[asked] = weights
    score = np.zeros(docs, np.int64)
    np.add.at(score, of, by_rank[ranks] * (10**9 * times // (1000 * times + 12 * m[of])))
    for i, (a, b) in enumerate(zip(tree.first, tree.last)):
        assert (tree.bounds[i, asked].astype(np.int64) * weights).sum() >= max(score[d] for d in tree.ids[a:b])
        kids = tree.children[i]
        assert not len(kids) or ([tree.first[k] for k in kids], [tree.last[k] for k in kids]) == ([a, *[tree.last[k] for k in kids[:-1]]], [*[tree.first[k] for k in kids[1:]], b])
    best = []
    tree.search(asked, weights, by_rank, best, 20)
    assert sorted([(-s, o.id) for s, o in best]) == sorted((-int(s), i) for i, s in enumerate(score))[:20]


def test_search_of_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "!!"), (4, "Apple apple"), (4, "apple"), (None, "apple"), (None, "apple"), (5, "long " * 400_000 + "apple"), (6, "x" * 3_000_000), (7, "ÄPFEL äpfel")]
    items = [(1, "APPLE"), (1, "apple"), (None, "long x"), (2, ""), (3, None), (4, "Äpfel"), (5, "x" * 3_000_000)]
    d = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id bigint, text string, rank int, Score string")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    assert found(lexical_search.top_documents(d, q)) == brute_search(docs, items, 20)
    assert found(lexical_search.top_documents(d.filter("false"), q)) == [] and found(lexical_search.top_documents(d, q.filter("false"))) == []


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical_search, "PIECE_BYTES", 5)
    for text in ("", "a", "one two", "aa bb cc dd ee", "abcdefghijklmnop q", "x,,,,,,,,y", "日本語 日本"):
        assert [t.decode() for piece in lexical_search.terms_of(text.encode()) for t in piece] == words(text)
