"""Each operator against brute force or SQL, and on odd tables: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import time
import zlib
from collections import Counter
from math import log10

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from penstock.llm import html, lm, pii, queries, toxicity
from penstock.llm.common import fold, keyed, shown_id
from penstock.llm.decontaminate import contamination
from penstock.llm.licenses import license_scan
from penstock.llm.license_texts import TEXTS
from penstock.llm.mixing import mix
from penstock.llm.simhash import components, near_duplicates, near_links
from penstock.llm.substrings import remove_repeats
from penstock.llm.topk import exact_top_k

SF = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"w{i}" for i in range(40))
ODD = [
    (1, PASSAGE + " tail one", "en", "b", 5),
    (2, "head " + PASSAGE, "en", "a", 5),
    (2, "head " + PASSAGE, "en", "a", 5),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " \t\n\x0b\x0c\r ", "en", None, 3),
    (6, "a " * 60, "en", "c", 120),
    (None, PASSAGE, "en", "c", 5),
    (7, "É x y Z\x00z " + PASSAGE.upper(), "fr", "é", 9),
    (8, " ".join(f"v{i % 5000}" for i in range(15000)), "en", "a", 9),
    (9, PASSAGE + " tail one", "en", "a", 5),
    (10, "head " + " ".join(f"w{i}" for i in range(20)) + " other", "en", "b", 5),
]
#: Names that operators use inside.
CLASHING = ["doc", "tag", "n", "key", "pos", "word", "size", "print", "node", "words", "found", "copies"]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *[F.lit("x").alias(c) for c in CLASHING]).repartition(3)


@pytest.fixture(scope="module")
def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def odd_db(**tables):
    connection = duckdb.connect()
    for name, frame in tables.items():
        connection.register(name, pa.Table.from_batches(frame.toArrow().to_batches(), frame.toArrow().schema))
    return connection


def canonical(rows):
    return sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in row) for row in rows)


def same_as_sql(result, connection, sql):
    columns = sorted(result.columns)
    expected = connection.execute(sql)
    names = [c[0] for c in expected.description]
    assert sorted(names) == columns
    rows = [[row[names.index(c)] for c in columns] for row in expected.fetchall()]
    assert canonical(rows) == canonical(result.select(*columns).collect())


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_registered_sql(spark, db, name):
    same_as_sql(queries.QUERIES[name](spark, SF), db, queries.ORACLE[name])


def documents(db):
    return db.execute("select doc_id, text from documents").fetchall()


# substring dedup


def kept_by_force(rows, length=20):
    """Result of every row, by sorted id; equal ids are one document."""
    seen, out = {}, {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r)):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for a in range(len(words) - length + 1):
            window = tuple(words[a : a + length])
            if seen.setdefault(window, (doc, a)) != (doc, a):
                gone[a : a + length] = [True] * length
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc, text or ""] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_substring_dedup(spark, db):
    rows = documents(db)
    force = kept_by_force(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.QUERIES["op1_substring_dedup"](spark, SF).collect()}
    assert got == {doc: v for (doc, _), v in force.items()}
    assert sum(v[1] for v in got.values()) > 1000


def test_substring_dedup_odd(odd, empty):
    force = kept_by_force([(r[0], r[1]) for r in ODD])
    got = remove_repeats(odd).collect()
    assert len(got) == len(ODD)
    expected = Counter((r[0], *force[r[0], r[1] or ""]) for r in ODD)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == expected
    spans = {r.doc_id: [tuple(s) for s in r.repeats] for r in got}
    assert spans[2] == [(1, 40)] and spans[9] == [(0, 41)] and spans[10] == [(0, 20)]
    assert remove_repeats(empty).count() == 0


def test_near_repeats_of_many_contexts(spark):
    """Anchors with many different surroundings, some of which agree in part."""
    rng = np.random.default_rng(3)
    core = [f"c{i}" for i in range(30)]
    rows = []
    for doc in range(60):
        words = [f"x{rng.integers(4)}" for _ in range(rng.integers(0, 25))] + core[: rng.integers(10, 30)] + [f"y{rng.integers(3)}" for _ in range(rng.integers(0, 30))]
        rows.append((doc, " ".join(words)))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {doc: v for (doc, _), v in kept_by_force(rows).items()}


# SimHash


def print_by_force(text, shingle=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_force(prints):
    """doc -> smallest doc reachable; prints: (doc, print)."""
    parent = {d: d for d, _ in prints}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, (a, x) in enumerate(prints):
        for b, y in prints[i + 1 :]:
            if (x ^ y).bit_count() <= 2:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {d: root(d) for d in parent}


def test_simhash(spark, db):
    prints = [(d, print_by_force(t)) for d, t in documents(db)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op5_simhash"](spark, SF).collect()}
    groups = groups_by_force(prints)
    assert got == {d: (f"{x:016x}", groups[d]) for d, x in prints}


def test_simhash_odd(odd, empty):
    found = near_duplicates(keyed(odd)).select(shown_id().alias("doc_id"), "print", F.col("component").alias("c")).collect()
    assert len(found) == len(ODD)
    assert {r["print"] for r in found if r.doc_id in (3, 4, 5)} == {0}
    of = {r.doc_id: r.c for r in found}
    assert of[3] == of[4] == of[5] == 3 and of[9] == of[1] == of[None] == 1
    assert near_duplicates(keyed(empty)).count() == 0


@pytest.mark.parametrize("max_diff", [1, 2])
@pytest.mark.parametrize("spread", [3, 40])
def test_links_of_dense_groups(spark, max_diff, spread):
    """Many prints within a few bits of each other, beside scattered ones; also through the flipped values."""
    rng = np.random.default_rng(spread)
    centre = int(rng.integers(2**63))
    prints = {centre ^ (1 << int(rng.integers(spread))) ^ (1 << int(rng.integers(spread))) for _ in range(150)}
    prints |= {int(rng.integers(2**63)) for _ in range(100)}
    prints |= {p ^ (1 << 63) for p in list(prints)[:20]}
    rows = [(i, p if p < 2**63 else p - 2**64) for i, p in enumerate(sorted(prints))]
    links = near_links(spark.createDataFrame(rows, "node long, print long"), max_diff)
    got = {r.node: r.root for r in components(links).collect()}
    nodes = [(i, p % 2**64) for i, p in rows]
    parent = {i: i for i, _ in nodes}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in nodes:
        for j, y in nodes[i + 1 :]:
            if (x ^ y).bit_count() <= max_diff:
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    assert {i: got.get(i, i) for i, _ in nodes} == {i: root(i) for i, _ in nodes}


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 150)] + [(300, k) for k in range(301, 340)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(2, 61)} | {150: 100, 200: 100} | {k: 300 for k in range(301, 340)}


# mixing


def test_mix_odd(odd, empty):
    rows = mix(odd).collect()
    assert len(rows) == len(ODD)
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r["size"]
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
    assert all(r.source_size == sizes[r.source] and r.target <= 3 * r.source_size + 1e-6 for r in rows)
    targets = {r.source: r.target for r in rows}
    assert abs(sum(targets.values()) - sum(sizes.values())) < 1e-6
    assert targets[None] == 0
    assert mix(empty).count() == 0


def test_mix_comes_near_targets(spark):
    rows = [(i, "w " * (1 + i * 7919 % 90), f"s{i % 7 if i % 3 else 0}") for i in range(3000)]
    found = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(
        F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("largest")
    )
    for r in found.collect():
        assert abs(r.taken - r.target) <= 3 * r.largest


# HTML


def test_html():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p > b {x: "<p>"}</style></head><body><header>Site</header>
      <nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><div class="cookie-banner">We use cookies on this site and you can say no to all of them</div>
      <main><header><h1>Title &amp; more</h1></header><p>The first &lt;block&gt; is&nbsp;long enough to be told from all of the others by its many stop words,
      as it has more of them than any.<p>Short.<ul class=related-links><li><a href=/c>See this one too</a></ul>
      <script>if (a < b) document.write("<p>no</p>")</script><p>Last one.<form>Name <input name=n></form></main>
      <div id="comments"><p>I think that this is the best of all the things that I have read in my life so far, and so on.</p></div>
      <footer>&copy; somebody</footer></body></html>"""
    lines = html.main_text(page).split("\n")
    assert lines[0] == "Title & more" and lines[1].startswith("The first <block> is long") and lines[2:] == ["Short.", "Last one."]
    assert html.main_text("") == "" and html.main_text("<p") == "" and html.main_text("plain &eacute; text") == "plain é text"
    assert html.main_text("<article><p>cut off in the mid") == "cut off in the mid"
    assert html.main_text("<nav><a href='/x'>Menu</a></nav>") == ""


def test_html_query(spark, db):
    pages = {r[0]: r[1] for r in db.execute("select page_id, html from pages").fetchall()}
    got = queries.QUERIES["op4_html_text"](spark, SF).collect()
    assert len(got) == len(pages)
    assert all(r.n_chars == len(r.text) and "<" not in r.text and r.text for r in got)
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "")], "page_id long, url string, html string")
    assert [(r.text, r.n_chars) for r in html.extract_text(odd).collect()] == [("", 0)] * 3


# licences


def test_license_scan(spark, odd, empty):
    mit = next(text for name, text in TEXTS if name == "MIT")
    variant = "Copyright (c) 2020 Jane Roe\n\n" + mit.upper().replace("\n\n", "\n").replace('"', "“").replace("SUBLICENSE", "SUB-LICENCE")
    rows = [(1, variant), (2, "text\n  released under the MIT licence\n"), (3, None), (4, mit[:-9]), (4, mit[:-9])]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.license, r.notices) for r in got) == Counter(
        {(1, "MIT", ""): 1, (2, None, "MIT"): 1, (3, None, ""): 1, (4, None, ""): 2}
    )
    same_as_sql(license_scan(odd), odd_db(documents=odd.select("doc_id", "text")), queries.ORACLE["op6_license_scan"])
    assert license_scan(empty).count() == 0


def test_license_scan_of_long_texts(spark):
    """Entire long licences, wrapped in another way or without their appendix; and a catalogue table."""
    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0"}
    texts = {}
    for i, name in enumerate(names):
        with open(f"/usr/share/common-licenses/{name}") as f:
            texts[i] = f.read()
    rows = [(i, t.upper().replace("\n", "\n\n ")) for i, t in texts.items()]
    rows += [(20, texts[0][: texts[0].index("   APPENDIX")]), (21, texts[0][:-30]), (22, "Do as you like.")]
    more = spark.createDataFrame([("Own", "do as YOU like")], "license string, text string")
    got = {r.doc_id: r.license for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string"), more=more).collect()}
    assert got == dict(enumerate(names.values())) | {20: "Apache-2.0", 21: None, 22: "Own"}


# LM scores


def test_lm(spark, db):
    rows = documents(db)
    tokens = {d: [*(t or "").encode().lower().split(), b"\n"] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in tokens}
    counts = Counter(w for d in tokens if not held[d] for w in tokens[d])
    total, types = counts.total(), len(counts)
    got = queries.QUERIES["op7_lm_scores"](spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        base = sum(log10((counts[w] + 0.5) / (total + 0.5 * (types + 1))) for w in tokens[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known) == (held[r.doc_id], len(tokens[r.doc_id]), sum(counts[w] > 0 for w in tokens[r.doc_id]))
        assert r.train_tokens == total and abs(r.base_score - base) < 1e-6 * max(1, abs(base))
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_lm_rare_words_and_odd_rows(spark, odd, empty):
    """With high shares most words are outside the automaton; base scores stay the same."""
    rows = keyed(odd)
    many, few = lm.lm_scores(rows, rows), lm.lm_scores(rows, rows, word_share=0.02, ngram_share=0.02)
    left, right = ({(r.doc, r.tag): r for r in x.collect()} for x in (many, few))
    assert left.keys() == right.keys() and many.count() == len(ODD)
    for key, r in left.items():
        assert abs(r.base_score - right[key].base_score) < 1e-6 and (r.n_known, r.n_tokens) == (right[key].n_known, right[key].n_tokens)
    assert lm.lm_scores(keyed(empty), keyed(empty)).count() == 0
    untrained = lm.lm_scores(rows, keyed(empty)).collect()
    assert {(r.score, r.n_known, r.train_tokens) for r in untrained} == {(0.0, 0, 0)}


def scores_by_force(train, texts, least=2):
    """Traversals of the automaton over all words and all n-grams that occur `least` times."""
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    counts = Counter(w for t in train for w in tokens(t))
    number = {w: i for i, w in enumerate(counts)}
    floor = counts.total() + 0.5 * (len(counts) + 1)
    grams = []
    for order in (2, 3):
        ids = [[len(number), *(number[w] for w in tokens(t))] for t in train]
        found = Counter(tuple(t[i : i + order]) for t in ids for i in range(len(t) + 1 - order))
        kept = {g: n for g, n in found.items() if n >= least}
        grams.append((np.array([sum(x << lm.BITS * (order - 1 - k) for k, x in enumerate(g)) for g in kept], np.int64), np.array(list(kept.values()))))
    automaton = lm.Automaton([log10((n + 0.5) / floor) for n in counts.values()], list(counts.values()), grams, len(train))
    unknown = log10(0.5 / floor)
    return [lm._traverse([number.get(w, -1) for w in tokens(t)], automaton.tables()) + unknown * sum(w not in number for w in tokens(t)) for t in texts]


def test_lm_keeps_ngrams_at_any_share(spark, db):
    """The shares only decide what is broadcast: n-grams far below them, and all orders of rare words, count as by definition."""
    rows = [(d, t) for d, t in documents(db)[:120]] + [(10**6, "new words of no training text"), (10**6 + 1, ""), (10**6 + 1, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    train = frame.where("doc_id % 4 != 0")
    force = dict(zip([d for d, _ in rows], scores_by_force([t for d, t in rows if d % 4], [t for _, t in rows]), strict=True))
    for share in ({}, {"word_share": 0.001, "ngram_share": 0.0005}, {"word_share": 1.0, "ngram_share": 1.0}):
        got = lm.lm_scores(keyed(frame), keyed(train), **share).collect()
        assert len(got) == len(rows)
        assert all(abs(r.score - force[r.doc]) < 1e-6 * max(1, abs(force[r.doc])) for r in got)


def test_lm_reads_texts_once_and_cuts_them_anywhere(spark, db):
    """Each text is read and cut into words once; blocks and parts of any size, and texts of many blocks, give the scores by definition."""
    rows = documents(db)[:60]
    rows += [(10**6, " ".join(t or "" for _, t in rows[:8])), (10**6 + 1, "a " + "x" * 2000 + "\x0b b\x1c " + "y" * 2000), (10**6 + 2, " \n"), (10**6 + 2, " \n")]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    docs = keyed(frame.mapInArrow(counted, "doc_id long, text string"))
    force = dict(zip([d for d, _ in rows], scores_by_force([t for d, t in rows if d % 4 != 1], [t for _, t in rows]), strict=True))
    for cut, train in (({}, "doc % 4 != 1"), ({"block_tokens": 100, "part_keys": 1500}, "doc % 4 != 1"), ({"block_tokens": 100}, None)):
        seen.value = 0
        got = lm.lm_scores(docs, F.expr(train) if train else docs.where("doc % 4 != 1"), **cut).collect()
        assert len(got) == len(rows)
        assert seen.value == (len(rows) if train else 2 * len(rows))
        assert all(abs(r.score - force[r.doc]) < 1e-9 * max(1, abs(force[r.doc])) for r in got)


def test_automaton_is_a_distribution():
    """Over all words, known or not, the chances after any history sum to one; the traversal agrees with the definition."""
    rng = np.random.default_rng(1)
    words = 12
    texts = [list(rng.integers(0, words - 1, rng.integers(1, 30))) + [words - 1] for _ in range(200)]
    unigrams = Counter(int(w) for t in texts for w in t)
    total = unigrams.total()
    floor = total + 0.5 * (words + 1)
    bottom = [log10((unigrams[w] + 0.5) / floor) for w in range(words)]
    grams = []
    for order in (2, 3):
        counts = Counter(tuple(int(x) for x in ([words, *t])[i : i + order]) for t in texts for i in range(len(t) + 2 - order))
        kept = {g: n for g, n in counts.items() if n >= 6}
        keys = np.array([sum(x << lm.BITS * (order - 1 - k) for k, x in enumerate(g)) for g in kept], np.int64)
        grams.append((keys, np.array(list(kept.values()))))
    automaton = lm.Automaton(bottom, [unigrams[w] for w in range(words)], grams, len(texts))
    arcs, failure, weight, _, _, _ = automaton.tables()

    def chance(state, word):
        if state and (arc := arcs.get(state << lm.BITS | word)):
            return 10 ** arc[0]
        return 10 ** weight[state] * chance(failure[state], word) if state else 10 ** bottom[word]

    def unknown(state):
        return 10 ** weight[state] * unknown(failure[state]) if state else 0.5 / floor

    assert len(automaton.state) > 10
    for state in range(len(automaton.state)):
        assert abs(sum(chance(state, w) for w in range(words)) + unknown(state) - 1) < 1e-9


# personal values


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms(spark, odd, empty):
    text = (
        "4111 1111 1111 1111, 4111111111111111 and 4111111111111112; +1 (521) 555-2373 or (521) 555-2373; 70.23.22.57. but not 300.1.1.1 "
        "born 1984-02-29, 29.02.1984, never 2023-02-30; 123-45-6789 not 666-45-6789; a.b.92@mail2.example.com GB82 WEST 1234 5698 7654 32"
    )
    rows = spark.createDataFrame([(1, text), (2, "4111-1111-1111-1111 " * 2), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymised(rows, "key", found="found").collect()}
    new = {f.old: f.new for f in got[1].found}
    assert len(new) == 10 and all(old != value and len(old) == len(value) for old, value in new.items())
    digits = lambda x: "".join(c for c in x if c.isdigit())
    assert luhn(digits(new["4111111111111111"])) and digits(new["4111 1111 1111 1111"]) == new["4111111111111111"]
    assert digits(got[2].found[0].new) == new["4111111111111111"]
    assert new["+1 (521) 555-2373"].endswith(new["(521) 555-2373"])
    assert new["1984-02-29"].split("-")[::-1] == new["29.02.1984"].split(".")
    assert [len(x) for x in new["70.23.22.57"].split(".")] == [2, 2, 2, 2]
    account = new["GB82 WEST 1234 5698 7654 32"].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1
    for left in ("4111111111111112", "300.1.1.1", "2023-02-30", "666-45-6789"):
        assert left in got[1].text
    rest = got[1].text
    for value in new.values():
        rest = rest.replace(value, "", 1)
    assert len(rest) == len(text) - sum(len(f.old) for f in got[1].found)
    assert got[3].text is None and got[4].text == "" and got[3].found == got[4].found == []
    assert pii.pseudonymised(empty, "key", found="found").count() == 0
    plain = pii.pseudonymised(odd, "key")
    assert plain.columns == odd.columns and canonical(plain.collect()) == canonical(odd.collect())


def test_permutations_are_one_to_one(spark):
    numbers = spark.range(0, 6 * 35)
    turned = numbers.select("id", pii.permuted_number(F.col("id"), "key", "kind", 6, 35).alias("to"))
    rows = turned.collect()
    assert sorted(r.to for r in rows) == list(range(210)) and sum(r.id == r.to for r in rows) < 10
    texts = spark.range(0, 1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("a"))
    assert texts.select(pii.permuted_text(F.col("a"), "key", "kind").alias("b")).distinct().count() == 1000
    assert numbers.select(pii.permuted_number(F.col("id"), "other", "kind", 6, 35)).collect() != [(r.to,) for r in rows]


# top-k


def test_top_k_odd(spark):
    rows = [(i, [((i * 37 + k * 11) % 64 - 32) / 40 for k in range(6)]) for i in range(300)]
    rows += [(0, rows[0][1]), (7, rows[7][1]), (400, None), (450, [0.5, None, 0.1, 0.0, 0.0, 0.0]), (500, [float("nan")] * 6), (550, [float("inf")] * 6)]
    rows += [(600, [0.3, 0.4]), (601, [0.1, -0.9]), (650, []), (None, rows[0][1])] + [(700 + i, rows[50][1]) for i in range(12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("tag", F.lit(1))
    single = frame.where("vec_id is not null").dropDuplicates(["vec_id"]).select("vec_id", "embedding")
    found = exact_top_k(frame, F.col("vec") % 50 == 0)
    same_as_sql(found, odd_db(embeddings=single), queries.ORACLE["op9_exact_top_k"])
    assert exact_top_k(frame.where("false"), F.col("vec") % 50 == 0).count() == 0


def test_slash_dates_one_to_one(spark):
    """Every date of a cycle in both readings with slashes, and a year before it, has a pseudonym of its own and keeps its form."""
    days = spark.sql("select explode(sequence(date'1799-01-01', date'2199-12-31')) as d")
    texts = days.selectExpr("explode(array(date_format(d, 'MM/dd/yyyy'), date_format(d, 'dd/MM/yyyy'), date_format(d, 'dd.MM.yyyy'), date_format(d, 'yyyy-MM-dd'))) as text").distinct()
    done = pii.pseudonymised(texts.withColumn("was", F.col("text")), "k")
    late = lambda c: F.substring(c, 1, 2) > "12"
    row = done.agg(
        F.count("*").alias("n"), F.count_distinct("text").alias("different"), F.count_if(F.regexp_replace("text", "[0-9]", "9") != F.regexp_replace("was", "[0-9]", "9")).alias("form"),
        F.count_if(F.col("was").contains("/") & (late("was") != late("text"))).alias("reading"), F.count_if(F.col("text") == F.col("was")).alias("same"),
    ).first()
    assert row.n == row.different and row.form == row.reading == 0 and row.same < 100


def _iban(country, account):
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{country}{98 - int(number) % 97:02d}{account}"


def test_spaced_ibans_before_words(spark):
    compact = [_iban("ES", "21000418450200051332"), _iban("AT", "1904300234573201"), _iban("SE", "50000000058398257466"), _iban("BE", "539007547034"), _iban("PL", "109010140000071219812874"), _iban("NO", "86011117947")]
    spaced = [" ".join(x[i : i + 4] for i in range(0, len(x), 4)) for x in compact]
    texts = [(i, f"{x} {word}") for i, x in enumerate([*spaced, *compact]) for word in ("EUR 50", "AB12", "A", "2024", "and more", "")]
    got = pii.pseudonymised(spark.createDataFrame(texts, "id int, text string"), "k", found="found").collect()
    for row in got:
        assert len(row.found) == 1 and row.found[0].kind == "iban" and row.found[0].old in [*spaced, *compact], row
    # equal values stay linked, spaced or not
    new = {r.found[0].old.replace(" ", ""): set() for r in got}
    for r in got:
        new[r.found[0].old.replace(" ", "")].add(r.found[0].new.replace(" ", ""))
    assert all(len(x) == 1 for x in new.values()) and len(new) == len(compact)


def test_missing_key_is_said(spark):
    with pytest.warns(UserWarning, match="public test key"):
        pii.pseudonym_key(spark)


PARAGRAPH = "<p>" + "This is the first long paragraph of the article, and it has all that one would want of a text with the usual words in it. " * 3 + "</p>"
RUSSIAN = "<p>" + "Сегодня в городе прошло заседание комиссии, на котором обсуждались планы развития транспорта и жилищного строительства. " * 3 + "</p>"
CHINESE = "<p>" + "今天市政府召开会议，讨论了新区交通和住房建设的发展计划，并听取了专家的意见和建议。" * 4 + "</p>"
TURKISH = "<p>" + "Bugün şehirde ulaşım planları ve yeni konut projeleri üzerine geniş katılımlı toplantı yapıldı, uzmanlar görüşlerini paylaştı. " * 3 + "</p>"
PAGES = {
    f'<body><nav>a b</nav><div class="content has-sidebar">{PARAGRAPH * 2}</div></body>': 2,
    f'<div class="search-page"><article>{PARAGRAPH * 2}</article></div>': 2,
    f'<section class="post social-policy">{PARAGRAPH * 2}</section>': 2,
    f'<main><div class="post-with-ads">{PARAGRAPH * 2}</div></main>': 2,
    f"<div><a href=x>Главная</a></div><div>{RUSSIAN * 2}</div>": 2,
    f"<div>{CHINESE * 2}</div>": 2,
    f"<div>{TURKISH * 2}</div>": 2,
    f"<div>{PARAGRAPH * 2}</div><article><p>Read also this short teaser.</p></article>": 3,
    f'<div class="post">{PARAGRAPH}</div><div class="comments">{PARAGRAPH * 4}</div>': 1,
    f'<div class="wrap has-sidebar">{PARAGRAPH * 3}<div class="sidebar">{PARAGRAPH}</div></div>': 3,
    f'<div style="display:none">{PARAGRAPH * 3}</div><div>{PARAGRAPH}</div>': 1,
}


@pytest.mark.parametrize("page", PAGES)
def test_articles_of_other_layouts_stay(page):
    assert len(html.main_text(page).split("\n")) == PAGES[page]


def test_pages_odd(spark):
    """Very long pages, empty tables, clashing names, null and repeated rows."""
    long = "<article>" + "<p>The end of the day is near, and we were all there to see it come to that.</p>" * 40_000
    rows = [(1, "u", long), (2, None, None), (None, "v", "<p>x"), (2, None, None), (3, "w", "<div" * 100_000), (4, "w", "<b>" * 200_000 + "end")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars", "3 as blocks")
    got = html.extract_text(frame.repartition(2)).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    assert next(r.text for r in got if r.page_id == 1).count("\n") == 39_999
    assert [r.text for r in got if r.page_id == 2] == ["", ""]
    assert html.extract_text(frame.limit(0)).count() == 0


# decontamination


def test_contamination_odd(spark, odd, empty):
    items = [(1, PASSAGE.upper()), (2, "a a a"), (3, None), (4, "--"), (None, PASSAGE), (5, "É x"), (6, " ".join(f"v{i}" for i in range(4990, 5000)) + " " + " ".join(f"v{i}" for i in range(50)))]
    items += [items[0], (10, "tail one"), (7, "nowhere to be found")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    found = contamination(keyed(odd), benchmark).select(shown_id().alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    connection = odd_db(documents=odd.select("doc_id", "text").distinct(), benchmark=benchmark.select("item_id", "text").distinct())
    same_as_sql(found.distinct(), connection, queries.ORACLE["op10_decontaminate"].replace("FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)", "FROM d LEFT JOIN pos ON d.doc_id IS NOT DISTINCT FROM pos.doc_id LEFT JOIN its ON d.doc_id IS NOT DISTINCT FROM its.doc_id"))
    assert found.count() == len(ODD) and found.where("contaminated").count() >= 6
    assert contamination(keyed(empty), benchmark).count() == 0
    assert contamination(keyed(odd), benchmark.where("false")).where("n_hit > 0").count() == 0


def test_contamination_of_one_word_over_and_over(spark):
    """A document and an item of 20,000 equal words cost a row per place, not per pair of places."""
    docs = spark.createDataFrame([(1, "na " * 20_000), (2, "na " * 12 + "ta " + "na " * 12), (3, "ta " + "na " * 13)], "doc_id long, text string")
    items = spark.createDataFrame([("a", "na " * 20_000), ("b", "ta na")], "item_id string, text string")
    start = time.time()
    got = {r.doc: (r.n_words, r.n_hit, r.n_items) for r in contamination(keyed(docs), items).collect()}
    assert got == {1: (20_000, 20_000, 1), 2: (25, 2, 1), 3: (14, 14, 2)}
    assert time.time() - start < 90


def test_rows_of_equal_short_hashes_stay_apart(spark):
    """Two texts without an id whose 32-bit hashes agree: one is contaminated, the other isn't."""
    words = spark.range(120_000).selectExpr("concat('w', id, ' one two three') as text").withColumn("h", F.hash("text"))
    pair = words.groupBy("h").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a != b").first()
    docs = spark.createDataFrame([(None, pair.a), (None, pair.b)], "doc_id long, text string")
    items = spark.createDataFrame([("x", pair.a)], "item_id string, text string")
    assert docs.select(F.hash("text")).distinct().count() == 1
    assert sorted(r.n_hit for r in contamination(keyed(docs), items).collect()) == [0, 4]


# toxicity


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.QUERIES["op2_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in got)
    toxic = [r.predicted for r in got if labels[r.doc_id]]
    assert right >= 0.95 * len(got) and sum(toxic) >= 0.75 * len(toxic)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 10)] + [(None, 1, 1), (2, 0, 1), (77, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(odd, odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert {r.score for r in toxicity.toxicity(odd, odd, labels.where("false")).collect()} == {0.0}
    assert toxicity.toxicity(empty, odd, labels).count() == 0


def test_folds(spark):
    rows = spark.range(200).select("id", fold("id", 3).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 3 for r in rows)
