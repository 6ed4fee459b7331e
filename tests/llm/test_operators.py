"""The text operators against brute force, round trips and edge cases."""

import datetime
import hashlib
import io
import itertools
import re
import time
import zlib
from urllib.parse import urljoin

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dwellspark.llm import components, decontaminate, hamming_search, packed_ids, packing, pretokens, pseudonyms, quality, queries, simhash, token_counts, url_filter, warc
from dwellspark.llm.shared import new_path

SMALL = "/root/testdata/sf0.001"
BYTE, WORD, PIECE = (public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
HARD = [None, "", " ", "a", "  two  blanks \n\n x", "end<|endoftext|> and <|startoftext|>x", "é ́x 日本 語　 か", "x\u0085 y  z\x1f q", "it's 's 't", "word " * 30_000, "nospace" * 5_000]


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(i, t, "s", "clash") for i, t in enumerate(HARD)] + [(3, "a", None, None), (None, "null id", "s", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, N_Tokens string")


def empty(df):
    return df.filter("false")


# 1 ---------------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    out = queries.op1_quality_classifier(spark, "/root/testdata/sf0.01").join(queries.table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").toPandas()
    test = out[out.held_out]
    assert len(test) > 50 and (test.predicted == test.quality).mean() > 0.95
    assert test[test.quality == 1].predicted.mean() > 0.98


def test_marginals_are_those_of_all_labellings():
    rng = np.random.default_rng(1)
    first, emit, tie = np.array([0, 3, 4]), rng.normal(size=4), rng.normal(size=(2, 2))
    good, pairs = quality.marginals(first, emit, tie)
    want, seen = np.zeros(4), np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:]):
        weights = {}
        for ys in itertools.product((0, 1), repeat=b - a):
            weights[ys] = np.exp(sum(emit[a + i] for i, y in enumerate(ys) if y) + sum(tie[p, q] for p, q in zip(ys, ys[1:])))
        z = sum(weights.values())
        for ys, w in weights.items():
            want[a:b] += np.array(ys) * w / z
            for p, q in zip(ys, ys[1:]):
                seen[p, q] += w / z
    assert np.allclose(good, want) and np.allclose(pairs, seen)


def brute_lines(text):
    """A line's features, byte by byte."""
    lines = text.encode().split(b"\n")
    out = []
    for line in lines:
        kinds = [int(quality.CLASSES[b]) for b in line]
        words = re.findall(rb"[^ \t\r\x0b\x0c]+", line)
        n = lambda k: kinds.count(k)  # noqa: B023, E731
        letters, length, count = max(1, n(quality.UPPER) + n(quality.LOWER) + n(quality.WIDE)), max(1, len(line)), max(1, len(words))
        odd = sum(int(quality.CLASSES[w[-1]]) in (quality.SYMBOL, quality.EXCLAIM, quality.BAR) for w in words)
        again = sum(a == b for a, b in zip(words, words[1:]))
        x = [
            1, np.log1p(len(line)) / 5, n(quality.UPPER) / letters, n(quality.DIGIT) / length, n(quality.BLANK) / length, n(quality.MARK) / count, n(quality.SYMBOL) / count, n(quality.EXCLAIM) / count,
            n(quality.BAR) / count, n(quality.WIDE) / length, length / count / 10, odd / count, again / count, lines.count(line) > 1, len(line) < 20, not line,
        ]
        out.append([min(5.0, float(v)) for v in x])
    return out


def test_lines_and_scores_equal_brute_force():
    texts = ["One line", "", None, "a a b!\n\nSAME | x\nSAME | x\n tail  12 é#", "\n", "x\n" * 5 + "end", "zwei Wörter!!! ### ***"]
    first, size, x = quality.line_features(pa.array(texts))
    want = [brute_lines(t or "") for t in texts]
    assert np.diff(first).tolist() == [len(w) for w in want] and size.tolist() == [len(line) for t in texts for line in (t or "").encode().split(b"\n")]
    assert np.allclose(x, np.concatenate(want))
    rng = np.random.default_rng(2)
    field = quality.LineField(tuple(rng.normal(size=quality.N_FEATURES)), tuple(rng.normal(size=4)), 1.3, -0.2)
    got = field.documents(first, size, field.lines(first, x))
    tie = np.array(field.tie).reshape(2, 2)
    for i, lines in enumerate(want):
        if len(lines) > 6:
            continue
        wide = [np.concatenate([lines[j], lines[j - 1] if j else np.zeros(16), lines[j + 1] if j + 1 < len(lines) else np.zeros(16)]) for j in range(len(lines))]
        emit = [float(w @ np.array(field.weights)) for w in wide]
        weights = {ys: np.exp(sum(e for e, y in zip(emit, ys) if y) + sum(tie[p, q] for p, q in zip(ys, ys[1:]))) for ys in itertools.product((0, 1), repeat=len(lines))}
        good = [sum(w for ys, w in weights.items() if ys[j]) / sum(weights.values()) for j in range(len(lines))]
        length = [max(1, len(line)) for line in (texts[i] or "").encode().split(b"\n")]
        mean = np.clip(np.average(good, weights=length), 1e-4, 1 - 1e-4)
        assert np.isclose(got[i], 1 / (1 + np.exp(-(field.slope * np.log(mean / (1 - mean)) + field.shift))))


def test_quality_edges(spark, hard):
    field = quality.LineField((0.1,) * quality.N_FEATURES, (0.5, 0.0, 0.0, 0.5))
    out = quality.score(hard.withColumn("Score", F.lit("mine")), field).toPandas()
    assert len(out) == len(HARD) + 2 and out.score.between(0, 1).all() and out.n_lines.min() == 1
    assert quality.score(empty(hard), field).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.train(hard, labels).weights == (0.0,) * quality.N_FEATURES


# 2 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("path", [BYTE, WORD, PIECE])
def test_counts_equal_the_library(spark, hard, path):
    out = token_counts.count_tokens(hard, path, keep=["doc_id", "text"]).collect()
    lib = pretokens.library(path)
    size = (lambda t: len(lib.encode(t, add_special_tokens=False).ids)) if path.endswith(".json") else (lambda t: len(lib.encode(t)))
    assert len(out) == len(HARD) + 2
    for r in out:
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), size(r.text or ""), size(r.text or "") > 512)
    assert token_counts.count_tokens(empty(hard), path).count() == 0


def test_counts_over_real_texts(spark):
    out = queries.op2_token_counts(spark, SMALL).join(queries.table(spark, SMALL, "documents").select("doc_id", "text"), "doc_id").collect()
    lib = Tokenizer.from_file(BYTE)
    assert all(r.n_tokens == len(lib.encode(r.text, add_special_tokens=False).ids) for r in out)


# 3 ---------------------------------------------------------------------------------------

PAGES = [
    (1, "https://A.Example.net/es/1?x", None), (2, "http://a.org/old", '<link rel="canonical" href="https://a.example.net/es/1?x">'),
    (3, "http://b.org/y#frag", '<meta http-equiv="refresh" content="0; url=http://a.org/old">'), (4, "https://www.example.com/en/1", '<link href="http://b.org/y" rel=canonical>'),
    (5, "https://example.com/en/1", ""), (6, "no scheme", "x"), (7, None, None), (8, "http://x.com", "y"), (8, "http://x.com", "y"), (9, "http://c.org/", "plain"), (10, "http://sub.fr.net/fr/", ""),
]


@pytest.mark.parametrize("inline", [64, 2])
def test_url_verdicts(spark, monkeypatch, inline):
    monkeypatch.setattr(url_filter, "INLINE_RULES", inline)
    pages = spark.createDataFrame([(*p, "mine") for p in PAGES], "page_id int, url string, html string, Rule string")
    out = url_filter.judge(pages, url_filter.rules_table(spark, queries.URL_RULES)).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
    assert len(out) == len(PAGES)
    assert got[1] == ("a.example.net", "/es/1", "net/es/", "block")
    assert got[2][2:] == (None, "block") and got[3] == ("b.org", "/y", None, "block")  # aliases of page 1
    assert got[4][2:] == ("www.example.com/en/", "allow")  # an explicit allow among blocked aliases
    assert got[5][2:] == ("example.com/en/", "block") and got[6] == got[7] == ("", "", None, "allow")
    assert got[8][1:] == ("", None, "allow") and got[9][3] == "allow" and got[10][2:] == ("net/fr/", "block")
    assert url_filter.judge(empty(pages), url_filter.rules_table(spark, queries.URL_RULES)).count() == 0


def test_link_targets_are_resolved(spark):
    link = lambda x: f'<link rel="canonical" href="{x}">'
    away = [
        ("https://A.org/en/p/1", "/es/1", "https://a.org/es/1"), ("http://a.org/en/p/1", "2.html", "http://a.org/en/p/2.html"), ("http://a.org/en/p/1", "../x?y#z", "http://a.org/en/x?y"),
        ("https://a.org/en", "//B.net/es/1", "https://b.net/es/1"), ("http://a.org", "q", "http://a.org/q"), ("http://a.org/c?d", "?e=1&amp;f=2", "http://a.org/c?e=1&f=2"),
        ("http://a.org/d", "HTTP://C.net/Es?a&#38;b", "http://c.net/Es?a&b"), ("http://a.org/x/y", "..", "http://a.org/"), ("http://a.org/m", "mailto:x@y.org", None), ("http://a.org/n", "#top", None),
    ]
    pages = spark.createDataFrame([(u, link(t)) for u, t, _ in away] + [("http://a.org/base", '<base href="/deep/er/">' + link("p"))], "url string, html string")
    got = {(r.a, r.b) for r in url_filter.link_edges(pages).collect()}
    assert got == {(u.replace("A.org", "a.org"), w) for u, _, w in away if w} | {("http://a.org/base", "http://a.org/deep/er/p")}
    rows = [
        (1, "https://x.org/a", link("//A.Example.net/es/1?u=1&amp;v=2")), (2, "https://X.org/b#f", '<meta http-equiv="refresh" content="0; url=a">'), (3, "https://a.example.net/es/1?u=1&v=2", ""),
        (4, "https://x.org/c", link("/a")), (5, "https://x.org/d", link("/e")),
    ]
    out = url_filter.judge(spark.createDataFrame(rows, "page_id int, url string, html string"), url_filter.rules_table(spark, queries.URL_RULES)).collect()
    assert {r.page_id: r.verdict for r in out} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}


def test_links_of_odd_tags(spark):
    tags = [
        ('<link rel="shortlink  Canonical" href="/a b">', "http://h.org/a b"), ("<LINK href='/single' rel='canonical'/>", "http://h.org/single"), ("<link data-rel=canonical href=/no>", None),
        ('<link rel="canonicals" href="/no">', None), ("<meta content='5;URL=\"/q\"' http-equiv=Refresh>", "http://h.org/q"), ('<meta http-equiv="refresh" content="5">', None), ('<meta name="canonical" content="x">', None),
        ("<meta http-equiv=refresh content='0; url=/u v'>", "http://h.org/u"),
    ]
    pages = spark.createDataFrame([(f"http://h.org/{i}", t) for i, (t, _) in enumerate(tags)], "url string, html string")
    assert {(r.a, r.b) for r in url_filter.link_edges(pages).collect()} == {(f"http://h.org/{i}", w) for i, (_, w) in enumerate(tags) if w}


def test_resolution_equals_the_library(spark):
    bases = ["http://h.org", "https://h.org/", "http://h.org/a/b/c?x=/y", "http://h.org/a/b/"]
    targets = ["x", "./x", "../x", "../../x", "../../../x", "/x/../y", "//k.org/z", "?q=1", "http://k.org/a", "x/./y/", ".", "..", "x?y=../z"]
    rows = [(b, t) for b in bases for t in targets]
    got = spark.createDataFrame(rows, "b string, t string").select("b", "t", url_filter.resolved(F.col("t"), F.col("b")).alias("u")).collect()
    for r in got:
        base = r.b if r.b.count("/") > 2 else r.b + "/"
        assert r.u == urljoin(r.b if r.t.startswith("?") else base, r.t), (r.b, r.t)


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(80)] + [(5, 5)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    df = spark.createDataFrame([*edges, (7, None)], "a bigint, b bigint")
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    assert got == {x: root(x) for x in list(parent)} | {7: root(7)}


# 4 ---------------------------------------------------------------------------------------


def brute_print(text, width=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints_equal_brute_force(spark, hard):
    docs = queries.table(spark, SMALL, "documents").select("doc_id", "text").union(hard.select("doc_id", "text"))
    out = simhash.fingerprint(docs).collect()
    assert all(r.simhash % (1 << 64) == brute_print(r.text) for r in out)


@pytest.mark.parametrize("crowd", [64, 2])
def test_links_reach_all_pairs_at_two_bits(spark, crowd):
    rng = np.random.default_rng(5)
    codes = set()
    for centre in rng.integers(0, 1 << 63, 40).tolist() + [0]:
        codes.add(centre)
        for _ in range(12):
            centre ^= sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(1, 4)).tolist()))
            codes.add(centre)
    codes = sorted(codes)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "simhash bigint")
    near = {tuple(sorted((a, b))) for a, b in itertools.combinations(signed, 2) if bin((a ^ b) % (1 << 64)).count("1") <= 2}
    links = [(r.a, r.b) for r in simhash.links(df, crowd=crowd).collect()]
    assert {tuple(sorted(x)) for x in links} <= near and (crowd == 2 or {tuple(sorted(x)) for x in links} == near)
    label = {c: c for c in signed}
    for _ in range(len(signed)):
        before = dict(label)
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    got = {r.node: r.component for r in components.connected_components(simhash.links(df, crowd=crowd)).collect()}
    assert {c: got.get(c, c) for c in signed} == label


def test_groups_and_edges(spark, hard):
    rows = [(5, "one two three four"), (2, "ONE  two\nthree four"), (9, None), (7, " "), (None, "one two three four"), (1, "other words stand here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(5, 2), (2, 2), (9, 7), (7, 7), (None, 2), (1, 1)], key=str)
    assert sorted(r.doc_id for r in simhash.keep_first(docs.withColumn("simhash", F.lit("x"))).collect()) == [1, 2, 7]
    assert simhash.near_duplicates(empty(docs)).count() == 0
    assert simhash.near_duplicates(hard).count() == len(HARD) + 2


# 5 ---------------------------------------------------------------------------------------

ITEM = "A train leaves Paris at 9 and travels 120 km to meet another train from Paris that covers 120 km before the two of them stop"


def test_templates_find_reparameterised_items(spark, hard):
    filler = "some plain words that say nothing of note and go on for a while "
    changed = ITEM.replace("Paris", "Rome").replace("120", "95").replace("9 ", "7 ")
    torn = ITEM.replace("Paris at", "Rome at").replace("120 km before", "80 km before").replace("travels 120", "travels 95")
    rows = [(1, filler + ITEM), (2, filler + changed + filler), (3, filler * 5), (4, ITEM.upper()), (5, torn), (6, None), (7, " ".join(ITEM.split()[:9])), (2, filler + changed)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(10, ITEM), (11, "too short"), (12, None)], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate.matches(docs, items).collect()}
    assert {1, 2} <= set(got) and not {3, 6, 7} & set(got)
    assert got[1].share == 1.0 and got[1].replaced == 0 and got[2].replaced > 0
    assert 5 not in got or got[5].windows < got[2].windows  # windows with a torn slot are dropped
    kept = [r.doc_id for r in decontaminate.remove_contaminated(docs, items).collect()]
    assert 1 not in kept and 2 not in kept and {3, 6, 7} <= set(kept)
    assert decontaminate.matches(empty(docs), items).count() == 0 and decontaminate.matches(docs, empty(items)).count() == 0
    assert decontaminate.remove_contaminated(hard, items).count() == len(HARD) + 2


def brute_tokens(text):
    """(template tokens, their values, exact words): words one by one, runs of names joined."""
    tokens, words, open_name = [], [], False
    for line in re.split("\n", text or ""):
        open_name = False
        for word in re.findall(r"[^\x20\x09-\x0D]+", line):
            kind, _, _, _, core = decontaminate.word_facts(word)
            if kind == decontaminate.NOTHING:
                open_name = False
                continue
            words.append(core)
            bare = word.strip(decontaminate.STRIPPED)
            if kind == decontaminate.NAME and open_name and word.startswith(bare):
                tokens[-1][1] += " " + core
            else:
                if kind == decontaminate.UNIT and not (tokens and tokens[-1][0] == decontaminate.NUMBER):
                    kind = decontaminate.LITERAL
                tokens.append([kind, core])
            open_name = kind == decontaminate.NAME and word.endswith(bare)
    return tokens, words


def brute_windows(text):
    tokens, words = brute_tokens(text)
    mark = lambda k, c: c if k == decontaminate.LITERAL else decontaminate.PLACEHOLDER[k]
    templates = {}
    for i in range(len(tokens) - 7):
        part = tokens[i : i + 8]
        if sum(k == decontaminate.LITERAL for k, _ in part) >= 4:
            templates[i] = (tuple(mark(k, c) for k, c in part), [(mark(k, c), c) for k, c in part if k != decontaminate.LITERAL])
    return templates, words


def brute_matches(docs, items):
    """(document, item): windows of the best alignment, by comparing everything with everything."""
    found = {}
    made = {d: brute_windows(t) for d, t in docs}
    for item, text in items:
        templates, words = brute_windows(text)
        for d, (theirs, spoken) in made.items():
            if templates:
                lines = {}
                for i, (t, old) in templates.items():
                    for j, (u, new) in theirs.items():
                        if t == u:
                            lines.setdefault(j - i, []).append(list(zip(old, new)))
                best = 0
                for hits in lines.values():
                    values = {}
                    for o, r in itertools.chain(*hits):
                        values.setdefault(o, set()).add(r)
                    best = max(best, sum(all(len(values[o]) == 1 for o, _ in h) for h in hits))
                if best >= min(5, len(templates)):
                    found[d, item] = best
            elif words and (spoken == words if len(words) < 2 else any(spoken[i : i + len(words)] == words for i in range(len(spoken)))):
                found[d, item] = max(1, len(words) - 3)
    return found


STORY = "Anna has 12 apples. Ben has 7 apples. How many do they have?"


def test_matches_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, SMALL, "documents").collect()]
    items = [(r.item_id, r.text) for r in queries.table(spark, SMALL, "benchmark").collect()]
    items += [(1000, STORY), (1001, "Is 7 prime"), (1002, "Yes"), (1003, "1 2 3 4 5 6 7 8 9 10"), (1004, STORY), (1005, "Paul Miller met the old man in Paris on Monday before he went back home")]
    items += [(2000 + i, " ".join(docs[i][1].split()[5 : 5 + 3 * i])) for i in range(1, 12)]
    texts = [
        STORY, "Carla has 40 apples. David has 9 apples. How many do they have?", "so Carla has 40 apples. David has 9 apples. How many do they have? Well", "Carla has 40 apples. Carla has 9 apples. How many do they have?",
        "is 7 prime", "so Is 7 prime or not", "yes!", "yes it is", "count 1 2 3 4 5 6 7 8 9 10 11", "count 1 2 3 4 5 6 7 8 9 11",
        "Then New York met the old man in San Francisco on Friday before he went back home.", "Eva met the old man in Rome on Monday before he went back home", None, "", "Anna Bell",
    ]
    docs += list(enumerate(texts, 10_000))
    got = decontaminate.matches(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id): r.windows for r in got} == brute_matches(docs, items) and len(got) == len({(r.doc_id, r.item_id) for r in got})
    by_doc = {d: {r.item_id for r in got if r.doc_id == d} for d in range(10_000, 10_000 + len(texts))}
    assert by_doc[10_001] == by_doc[10_002] == {1000, 1004} and by_doc[10_010] == by_doc[10_011] == {1005}  # other names, numbers and word counts
    assert by_doc[10_004] == by_doc[10_005] == {1001} and by_doc[10_006] == {1002} and not by_doc[10_007] and by_doc[10_008] == {1003} and not by_doc[10_009]


def test_rows_are_judged_by_their_own_text(spark):
    words = ITEM.split()
    rows = [(None, ITEM), (None, "a clean text without an id"), (1, " ".join(words[:14])), (1, " ".join(words[10:])), (2, ITEM), (2, "a clean text of the same id"), (2, ITEM)]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id bigint, text string, same string")
    items = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    kept = [tuple(r)[:2] for r in decontaminate.remove_contaminated(docs, items, enough=12).collect()]
    assert sorted(kept, key=str) == sorted([rows[1], rows[2], rows[3], rows[5]], key=str)


def test_a_window_that_many_items_and_documents_share_makes_no_pairs(spark):
    """A thousand items and documents share one passage of two windows; each item needs five, one has a single window."""
    passage = "the committee has been asked to answer the following"
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(9))
    items = [(i, f"{passage} {own(i)}") for i in range(1000)] + [(5000, "quiet rivers carry small boats beyond old mills")]
    docs = [(i, f"{own(10_000 + i)} {passage} {own(20_000 + i)}") for i in range(1000)] + [(3000, items[7][1]), (3001, f"so {items[5000 - 4000][1]} again")]
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    seen = []
    settle = decontaminate.settle

    def watched(df, name, *args):
        out = settle(df, name, *args)
        seen.append((name, out[0].count()))
        return out

    decontaminate.settle = watched
    try:
        got = {(r.doc_id, r.item_id) for r in decontaminate.matches(d, q).collect()}
    finally:
        decontaminate.settle = settle
    assert got == {(3000, 7), (3001, 5000)}
    assert dict(seen)["benchmark-pairs"] <= 10 and dict(seen)["benchmark-hits"] <= 3 * len(docs) + 20


def test_extra_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, ITEM, "x", 2, 3), (2, "plain", "y", None, 4)], "doc_id bigint, text string, Key string, same int, item_id int")
    items = spark.createDataFrame([(10, ITEM, 1, "k")], "item_id bigint, text string, hash int, doc_id string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()] == [(1, 10)]
    assert [tuple(r) for r in decontaminate.remove_contaminated(docs, items).collect()] == [(2, "plain", "y", None, 4)]


def test_planted_items_are_found_and_clean_documents_kept(spark):
    sf = "/root/testdata/sf0.01"
    items = [r.text for r in queries.table(spark, sf, "benchmark").collect()]
    docs = queries.table(spark, sf, "documents").collect()
    holds = {r.doc_id for r in docs if any(" ".join(i.lower().split()) in " ".join(r.text.lower().split()) for i in items)}
    got = {r.doc_id for r in queries.op5_decontamination(spark, sf).collect()}
    assert holds <= got and len(got - holds) <= 2


# 6 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [1, 7, 8, 15, 16, 17, 31, 32])
def test_bits_round_trip(width, monkeypatch):
    monkeypatch.setattr(packed_ids, "SPREAD_IDS", 64)
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001, dtype=np.uint64).astype(np.uint32)
    data = packed_ids.pack(ids, width)
    assert len(data) == -(-1001 * width // 8)
    assert (packed_ids.unpack(data, width, 0, 1001) == ids).all() and (packed_ids.unpack(data, width, 333, 77) == ids[333:410]).all()


def test_files_hold_all_ids_in_order(spark, hard):
    lib = Tokenizer.from_file(WORD)
    for docs in (queries.table(spark, SMALL, "documents").select("doc_id", "text").repartition(3), hard):
        path = new_path(spark, "test-ids")
        packed_ids.write(docs, path, WORD, 2, block_ids=5000)
        rows = sorted(packed_ids.read(spark, path).collect(), key=lambda r: r.start)
        want = sorted(([r.doc_id, lib.encode(r.text or "", add_special_tokens=False).ids + [2]] for r in docs.collect()), key=lambda x: (x[0] is not None, x[0]))
        assert [r.doc_id for r in rows] == [d for d, _ in want] and [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])[:-1]]).tolist()
        assert sorted(bytes(r.ids) for r in rows) == sorted(np.array(i, "<u4").tobytes() for _, i in want)
    assert sorted(map(len, packed_ids.read_document(spark, path, 3)))[0] == len(want[[d for d, _ in want].index(3)][1])
    path = new_path(spark, "test-ids")
    packed_ids.write(empty(hard), path, WORD, 2)
    assert packed_ids.read(spark, path).count() == 0


# 7 ---------------------------------------------------------------------------------------


def brute_digits(digits, kind, key):
    half, n = len(digits) // 2, len(digits)
    a, b = int(digits[:half]), int(digits[half:])
    for i in range(2 * pseudonyms.ROUNDS):
        f = lambda v: int(hashlib.sha256(f"{key}|{kind}{n}|{i}|{v}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        a, b = ((a + f(b)) % 10**half, b) if i % 2 == 0 else (a, (b + f(a)) % 10 ** (n - half))
    return f"{a:0{half}d}{b:0{n - half}d}"


def brute_walk(digits, kind, key, fits):
    digits = brute_digits(digits, kind, key)
    while not fits(digits):
        digits = brute_digits(digits, kind, key)
    return digits


def brute_pair(a, b, high, low, tweak, key):
    for i in range(2 * pseudonyms.ROUNDS):
        f = lambda v: int(hashlib.sha256(f"{key}|{tweak}|{i}|{v}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        a, b = ((a + f(b)) % high, b) if i % 2 == 0 else (a, (b + f(a)) % low)
    return a, b


def rewritten(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id int, text string")
    return {r.doc_id: r.text for r in pseudonyms.pseudonymise(df, "k").select("doc_id", "text").collect()}


def luhn(s):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def test_pseudonyms(spark, hard):
    card, other = "4539578763621486", "4539578763621487"
    texts = [f"card {card} and {card[:4]}-{card[4:8]}-{card[8:12]}-{card[12:]} not {other}", f"again {card}", "tel +1 (207) 555-7713, ssn 123-45-6789 or 000-12-3456", "ip 10.2.3.4 not 300.1.1.1", "on 2024-02-29, 31.12.1999, not 2023-02-30", "mail Some.One+x@host.example.com!", 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"', None, ""]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id int, text string, PII_found int")
    out = {r.doc_id: r for r in pseudonyms.pseudonymise(docs, "k").collect()}
    new = out[1].text.split()[1]
    assert luhn(card) and luhn(new) and new != card and new[:15] == brute_walk(card[:15], "card", "k", lambda d: "2" <= d[0] <= "6")
    assert out[0].text == f"card {new} and {new[:4]}-{new[4:8]}-{new[8:12]}-{new[12:]} not {other}" and dict(out[0].pii_found) == {"card": 2}
    d = brute_walk("2075557713", "phone", "k", lambda d: d[0] > "1" and d[3] > "1")
    assert f"({d[:3]}) {d[3:6]}-{d[6:]}" in out[2].text and "000-12-3456" in out[2].text and "123-45-6789" not in out[2].text
    assert "10.2.3.4" not in out[3].text and "300.1.1.1" in out[3].text and re.search(r"ip (\d+\.){3}\d+ not", out[3].text)
    assert re.fullmatch(r"on \d{4}-\d\d-\d\d, \d\d\.\d\d\.\d{4}, not 2023-02-30", out[4].text) and "2024-02-29" not in out[4].text
    assert "host" not in out[5].text and out[5].text.endswith("@mail.invalid!") and "b44e15e0" not in out[6].text and len(out[6].text) == len(texts[6])
    assert out[7].text is None and out[8].text == "" and dict(out[8].pii_found) == {}
    assert pseudonyms.pseudonymise(hard, "k").count() == len(HARD) + 2 and pseudonyms.pseudonymise(empty(hard), "k").count() == 0


def test_all_dates_get_different_pseudonyms(spark):
    zero = datetime.date(1900, 1, 1)
    days = [zero + datetime.timedelta(i) for i in range(1 << 16)]
    texts = sorted({d.strftime(f) for d in days for f in ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y")})
    got = rewritten(spark, texts)
    assert len(set(got.values())) == len(texts) and sum(got[i] == t for i, t in enumerate(texts)) < 200
    assert all(re.sub("[0-9]", "0", t) == re.sub("[0-9]", "0", got[i]) for i, t in enumerate(texts))

    def moved(d):
        a, b = brute_pair(*divmod((d - zero).days, 256), 256, 256, "date", "k")
        return zero + datetime.timedelta(256 * a + b)

    def walked(d):  # what reads as mm/dd alone must do so again
        d = moved(d)
        return d if d.day > 12 else walked(d)

    at = {t: i for i, t in enumerate(texts)}
    for d in days[::997]:
        assert got[at[d.strftime("%Y-%m-%d")]] == moved(d).strftime("%Y-%m-%d") and got[at[d.strftime("%d/%m/%Y")]] == moved(d).strftime("%d/%m/%Y")
        if d.day > 12:
            assert got[at[d.strftime("%m/%d/%Y")]] == walked(d).strftime("%m/%d/%Y")


def test_addresses_and_numbers_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    ips = [".".join(map(str, x)) for x in rng.integers(0, 256, (200, 4)).tolist()]
    ssns = [f"{a:03d}-{b:02d}-{c:04d}" for a, b, c in zip(rng.integers(1, 1000, 2000).tolist(), rng.integers(1, 100, 2000).tolist(), rng.integers(1, 10000, 2000).tolist())]
    got = rewritten(spark, ips + ssns)
    for i, t in enumerate(ips):
        o = list(map(int, t.split(".")))
        a, b = brute_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 1 << 16, 1 << 16, "ip", "k")
        assert got[i] == f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"
    real = lambda d: d[:3] != "000" and d[3:5] != "00" and d[5:] != "0000"
    for i, t in enumerate(ssns, len(ips)):
        d = brute_walk(t.replace("-", ""), "ssn", "k", real)
        assert got[i] == f"{d[:3]}-{d[3:5]}-{d[5:]}"


def test_telephones_stay_telephones(spark):
    """Every pseudonym is of its kind and layout again, equal digits stay linked, and none are shared."""
    rng = np.random.default_rng(9)
    tails = [f"{a:03d}{b:03d}{c:04d}" for a, b, c in zip(rng.integers(0, 1000, 2000).tolist(), rng.integers(0, 1000, 2000).tolist(), rng.integers(0, 10000, 2000).tolist())]
    tails = sorted({t for t in tails if t[0] > "1" and t[3] > "1"} | {f"555200{i:04d}" for i in range(1000, 1400)})
    plain = [f"{t[:3]} {t[3:6]} {t[6:]}" for t in tails]
    dashed = [f"{t[:3]}-{t[3:6]}-{t[6:]}" for t in tails]
    both = rewritten(spark, plain + dashed)
    got = [both[i] for i in range(len(both))]
    assert all(re.fullmatch(r"[2-9][0-9]{2} [2-9][0-9]{2} [0-9]{4}", x) for x in got[: len(plain)])
    assert [x.replace(" ", "") for x in got[: len(plain)]] == [x.replace("-", "") for x in got[len(plain) :]] and len(set(got)) == len(got)
    other = [f"{t[:3]}-{t[3:6]}-{t[6:]}" for t in (f"0{i:09d}" for i in range(0, 10**9, 10**7 + 7))]
    assert not {x.replace("-", "") for x in rewritten(spark, other).values()} & {x.replace(" ", "") for x in got[: len(plain)]}


def test_spellings_of_numbers(spark):
    phones = ["555-123-4567", "+1-555-123-4567", "1.555.123.4567", "555 223 4567", "(555) 123-4567", "+1 (555) 123-4567", "+49 30 1234567", "+442071234567"]
    cards = ["378282246310005", "3782 822463 10005", "3782-822463-10005"]
    plain = ["1700000000008", "100 200 3000", "555-123-45678", "12 555 223 4567 8", "3 + 4", "2024-02-30", "1234567890123"]
    got = rewritten(spark, phones + cards + plain)
    d = brute_walk("5551234567", "phone", "k", lambda d: d[0] < "2" or d[3] < "2")
    spelt = f"{d[:3]}-{d[3:6]}-{d[6:]}"
    assert [got[i] for i in (0, 1, 2, 4, 5)] == [spelt, "+1-" + spelt, "1." + spelt.replace("-", "."), f"({d[:3]}) {d[3:6]}-{d[6:]}", f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}"]
    assert all(got[i] != phones[i] and re.sub("[0-9]", "0", got[i]) == re.sub("[0-9]", "0", phones[i]) for i in range(len(phones)))
    new = brute_walk(cards[0][:14], "card", "k", lambda x: "2" <= x[0] <= "6")
    assert got[8][:14] == new and luhn(got[8]) and {got[8 + i].replace(" ", "").replace("-", "") for i in range(3)} == {got[8]}
    assert [got[11 + i] for i in range(len(plain))] == plain


def test_feistel_is_a_permutation(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    got = {r[0] for r in df.select(pseudonyms.permute_digits(F.col("d"), "t", "k")).collect()}
    assert got == {f"{i:03d}" for i in range(1000)}


# 8 ---------------------------------------------------------------------------------------


def nearest(ids, codes, query, k):
    far = np.bitwise_count((codes ^ query).astype(np.int64).view(np.uint64)).astype(int)
    return sorted((int(d), int(i)) for i, d in zip(ids, far))[:k]


@pytest.mark.parametrize("bucket,block", [(20_000, 5_000), (40, 2)])
def test_search_equals_brute_force(spark, bucket, block):
    rng = np.random.default_rng(8)
    near = np.array([77 ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (120, 2))])
    codes = np.concatenate([rng.integers(-(1 << 63), (1 << 63) - 1, 700), np.full(300, 12345), near])
    ids = np.concatenate([np.arange(len(codes) - 1), [5]])  # id 5 has two codes
    table = spark.createDataFrame([(int(i), int(c), "x") for i, c in zip(ids, codes)], "id bigint, code bigint, distance string")
    wanted = [0, 5, 650, 800, 801, 1010, 1040, 1041]
    got = hamming_search.top_k(table, table.filter(F.col("id").isin(wanted)).union(table.filter("id = 0")), k=7, bucket=bucket, block=block).collect()
    for q in wanted:
        want = [(n, *x) for c in codes[ids == q] for n, x in enumerate(nearest(ids, codes, c, 7), 1)] * (2 if q == 0 else 1)
        assert sorted((r.rank, r.distance, r.neighbor_id) for r in got if r.query_id == q) == sorted(want)


def test_search_edges(spark):
    vectors = spark.createDataFrame([(1, [0.5] * 64), (2, None), (3, []), (4, [float("nan")] * 63 + [None]), (None, [1.0] * 64)], "vec_id bigint, embedding array<float>")
    table = hamming_search.codes(vectors)
    assert {r.id: r.code for r in table.collect()} == {1: -1, 4: 0}
    found = hamming_search.top_k(table, table).collect()  # fewer codes than k
    assert sorted((r.query_id, r.rank, r.neighbor_id, r.distance) for r in found) == [(1, 1, 1, 0), (1, 2, 4, 64), (4, 1, 4, 0), (4, 2, 1, 64)]
    assert hamming_search.top_k(table.filter("false"), table).count() == 0 and hamming_search.top_k(table, table.filter("false")).count() == 0
    named = spark.createDataFrame([("a", 3), ("b", 1), (None, 3), ("c", None)], "id string, code bigint")
    assert [(r.query_id, r.neighbor_id) for r in hamming_search.top_k(named, named, k=1).collect() if r.query_id == "a"] == [("a", "a")]


def test_search_of_tables_with_clashing_columns(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=64).tolist(), i, "x", 1) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, Query int, code string, part int")
    codes = hamming_search.codes(table)
    assert codes.columns == ["id", "code"] and hamming_search.top_k(codes, codes.filter("id % 20 = 0"), k=3).count() == 9


def test_components_of_a_given_table_equal_brute_force(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r for r in queries.op4_simhash(spark, "/root/testdata/sf0.01").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    prints = simhash.fingerprints(pa.array([texts[i] for i in ids]), 3).view(np.uint64)
    assert [got[i].fingerprint for i in ids] == [f"{int(p):016x}" for p in prints]
    label = np.arange(len(ids))
    apart = np.array([[int(a ^ b).bit_count() <= 2 for b in prints.tolist()] for a in prints.tolist()])
    while True:
        after = np.where(apart, label, len(ids)).min(axis=1)
        if (after == label).all():
            break
        label = after
    assert [got[i].component_id for i in ids] == [ids[x] for x in label]


# 9 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("window,pool", [(2048, 1 << 24), (64, 3000)])
def test_pieces_cover_all_ids(spark, hard, window, pool):
    docs = queries.table(spark, SMALL, "documents").select("doc_id", "text").union(hard.filter("doc_id IS NOT NULL AND source IS NOT NULL").select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    rows = packing.pack(docs.repartition(2), BYTE, 1, window, pool_ids=pool).collect()
    lib, by_doc, by_seq = Tokenizer.from_file(BYTE), {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for d in docs.collect():
        pieces = sorted(by_doc[d.doc_id], key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(bytes(p.ids), "<u4") for p in pieces])
        assert ids.tolist() == lib.encode(d.text or "", add_special_tokens=False).ids + [1]
        assert [p.start for p in pieces] == np.cumsum([0] + [p.length for p in pieces])[:-1].tolist() and {p.doc_tokens for p in pieces} == {len(ids)}
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        used = sum(p.length for p in pieces)
        assert [p.offset for p in pieces] == np.cumsum([0] + [p.length for p in pieces])[:-1].tolist() and used <= window
        assert {p.padded_length for p in pieces} == {used if used & (used - 1) == 0 else window}
    if window == 2048:
        assert sum(p.length for p in rows) / sum(s[0].padded_length for s in by_seq.values()) > 0.95
    assert packing.pack(empty(docs), BYTE, 1).count() == 0


def test_best_fit_takes_the_tightest_window():
    lengths = np.random.default_rng(9).integers(1, 100, 400)
    number, offset = packing.best_fit(lengths, 100)
    room = {}
    for i in sorted(range(400), key=lambda i: -lengths[i]):  # stable, as the packer
        n = int(lengths[i])
        fit = min((r for r in room.values() if r >= n), default=None)
        before = room.get(int(number[i]), 100)
        assert before == (fit if fit is not None else 100) and offset[i] == 100 - before
        room[int(number[i])] = before - n


# 10 --------------------------------------------------------------------------------------


@pytest.mark.parametrize("broadcast", [100_000, -1])
def test_archives_round_trip(spark, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_REVISITS", broadcast)
    fake = "WARC/1.0\r\nWARC-Type: response\r\nX-Page-ID: 666\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "x" * 150), (2, "x" * 150), (3, "short"), (4, "short"), (5, None), (6, fake * 4 + "tail"), (7, "é" * 60), (None, "x" * 150), (9, fake), (1, "x" * 150)]
    rows += [(100 + i, fake + "y" * (i * 37 % 211)) for i in range(60)]
    pages = spark.createDataFrame([(*r, f"http://a.org/{r[0]}?x=\r\nWARC/1.0\r\n é", "mine") for r in rows], "page_id bigint, html string, url string, digest string").repartition(3)
    archives = warc.write(warc.plan(pages), new_path(spark, "test-warc"))
    for size in (97, 4096):
        got = warc.read(archives, range_bytes=size).collect()
        assert len(got) == len(rows)
        first = {}
        for i, h in rows:
            if i is not None and len((h or "").encode()) >= 100:
                first[h] = min(i, first.get(h, i))
        want = []
        for i, h in rows:
            body = (h or "").encode()
            to = first.get(h) if len(body) >= 100 and (i is None or i > first.get(h, i)) else None
            want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if to is not None else "response", to))
        assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    assert warc.read(warc.write(warc.plan(empty(pages)), new_path(spark, "test-warc"))).count() == 0
    one = spark.createDataFrame([tuple(archives.first())], archives.schema)
    path = one.first().path.removeprefix("file://")
    with open(path, "r+b") as f:
        f.truncate(one.first().bytes - 3)
    with pytest.raises(ValueError, match="don't end"):
        warc.read(one.withColumn("bytes", F.col("bytes") - 3))


def parsed(data):
    """(fields, block) of each record, as the format says."""
    at, out = 0, []
    while at < len(data):
        head, _, _ = data[at:].partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        assert version == "WARC/1.0"
        fields = dict(x.split(": ", 1) for x in lines)
        begin = at + len(head) + 4
        n = int(fields["Content-Length"])
        assert data[begin + n : begin + n + 4] == b"\r\n\r\n"
        out.append((fields, data[begin : begin + n]))
        at = begin + n + 4
    return out


def test_records_are_those_of_the_format(spark):
    rows = [("a b", "x" * 150, "http://a.org/é b"), ("c", "x" * 150, None), ("d", "tiny", "http://a.org/d"), (None, "y" * 120, "nothing")]
    pages = spark.createDataFrame(rows, "page_id string, html string, url string").coalesce(1)
    archives = warc.write(warc.plan(pages), new_path(spark, "test-warc"), date="2026-01-02T03:04:05Z")
    (archive,) = archives.collect()
    with open(archive.path.removeprefix("file://"), "rb") as f:
        records = parsed(f.read())
    assert len(records) == 4
    by_page = {f["X-Page-ID"]: (f, b) for f, b in records}
    for fields, block in records:
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "Content-Type"} <= set(fields) and fields["WARC-Date"] == "2026-01-02T03:04:05Z"
        assert fields["WARC-Type"] == "revisit" or block.startswith(b"HTTP/1.1 200 OK\r\n")
    assert by_page["a%20b"][0]["WARC-Target-URI"] == "http://a.org/%C3%A9%20b" and by_page["c"][0]["WARC-Target-URI"] == "urn:page:c"
    assert by_page["c"][0]["WARC-Refers-To"] == by_page["a%20b"][0]["WARC-Record-ID"] and by_page["c"][1] == b""
    got = {r.page_id: (r.record_type, r.refers_to, r.payload) for r in warc.read(archives, id_type="string").collect()}
    assert got == {"a b": ("response", None, b"x" * 150), "c": ("revisit", "a b", None), "d": ("response", None, b"tiny"), None: ("response", None, b"y" * 120)}


def test_long_urls_are_archived_whole(spark):
    urls = {1: "http://a.org/" + "x" * 40_004, 2: "http://a.org/" + "é" * 30_000, 3: "http://a.org/?" + "y" * 3_000_000, 4: "http://a.org/"}
    pages = spark.createDataFrame([(i, u, "z" * 150 + str(i), 5, "clash") for i, u in urls.items()], "page_id bigint, url string, html string, bytes int, Digest string")
    archives = warc.write(warc.plan(pages), new_path(spark, "long-urls"))
    got = {r.page_id: r.url for r in warc.read(archives, range_bytes=1 << 16).collect()}
    assert got == {i: u.replace("é", "%C3%A9") for i, u in urls.items()}


def test_repeated_magic_is_scanned_once():
    for part in (b"WARC/1.0\r\n", b"X: WARC/1.0\r\n", b"WARC/1.0\r\nA: b\r\n"):
        data = part * ((2 << 20) // len(part))
        began = time.time()
        assert not list(warc._in_range(io.BytesIO(data), 0, len(data), len(data)))
        assert time.time() - began < 1


def test_many_tiny_documents_fill_blocks_fast(spark):
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), F.lit(1).alias("lengths")).coalesce(1)
    path = new_path(spark, "tiny")
    began = time.time()
    packed_ids.write(docs, path, WORD, 2)
    assert time.time() - began < 60  # a sum per document took minutes
    row = packed_ids.read(spark, path).agg(F.count("doc_id").alias("n"), F.sum("n_tokens").alias("ids"), F.max("start").alias("last"), F.sum((F.col("start") != F.col("doc_id")).cast("int")).alias("off")).first()
    assert tuple(row) == (200_000, 200_000, 199_999, 0)


# registered queries ----------------------------------------------------------------------


def test_id_checksums(spark):
    lib = Tokenizer.from_file(WORD)
    texts = {r.doc_id: r.text for r in queries.table(spark, SMALL, "documents").collect()}
    for r in queries.op6_token_ids(spark, SMALL).collect():
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_native_operators_run_no_python(spark):
    for name in ("op3_url_filter", "op7_pii"):
        plan = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
