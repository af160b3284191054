"""The corpus pipeline, stage by stage, against the operators' brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from penstock.llm.common import staged
from tests.llm.test_operators import ODD, groups_by_force, odd, print_by_force  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), name)
        out.append(docs)
    return out


def test_columns(stages):
    for docs in stages[:-1]:
        assert docs.columns == stages[0].columns
    assert set(stages[0].columns) < set(stages[-1].columns)


def alike(a, b):
    words = [t.encode().lower().split() for t in (a, b)]
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words)
    return len(x & y) >= 0.8 * len(x | y) > 0


def test_one_of_each_group_stays(stages):
    before, after = ({r.doc_id: r.text for r in docs.collect()} for docs in stages[1:3])
    groups = groups_by_force([(d, print_by_force(t)) for d, t in before.items()])
    assert set(after) <= set(groups.values()) and len(after) < len(before)
    for gone in set(groups.values()) - set(after):
        assert any(alike(before[gone], text) for text in after.values())


def test_similar_texts_without_near_prints(spark):
    """Copies with one word in 40 changed, and other texts; also a large group."""
    rng = np.random.default_rng(8)
    base = [f"w{rng.integers(5000)}" for _ in range(300)]
    copy = lambda: " ".join(w if rng.random() > 1 / 90 else f"z{rng.integers(5000)}" for w in base)
    rows = [(i, copy(), "en", "a", 0) for i in range(80)] + [(100 + i, " ".join(f"w{rng.integers(5000)}" for _ in range(200)), "en", "a", 0) for i in range(30)]
    rows += [(200, None, "en", "a", 0), (201, "", "en", "a", 0), (202, "one two", "en", "a", 0), (203, "one three", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id: r.text for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert {100 + i for i in range(30)} | {200, 202, 203} == {d for d in kept if d >= 80}
    texts = dict((d, t) for d, t, *_ in rows)
    near = [d for d in kept if d < 80]
    assert near and not any(alike(texts[a], texts[b]) for i, a in enumerate(near) for b in near[i + 1 :])


def left_by_stage(spark, rows):
    docs = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()]


def test_star_and_template_groups(spark):
    """Copies alike to one original only, whose id is the largest; and alike pairs that share a template with all others."""
    original = [f"s{i}" for i in range(404)]
    star = [(i, " ".join([*(w if (k * 7 + i * 11) % 61 else f"c{i}x{k}" for k, w in enumerate(original))])) for i in range(60)]
    star.append((1000, " ".join(original)))
    template = [f"t{i}" for i in range(120)]
    rows = star + [(2000 + 2 * g + c, " ".join([*template, *(f"g{g}w{k}" for k in range(120 if c else 121))])) for g in range(30) for c in range(2)]
    kept = left_by_stage(spark, rows)
    texts = [t for _, t in kept]
    assert all(alike(t, star[-1][1]) for _, t in star) and not alike(star[0][1], star[1][1])
    assert [d for d, _ in kept if d <= 1000] == [0]
    assert sorted(d for d, _ in kept if d >= 2000) == [2000 + 2 * g for g in range(30)]
    assert not any(alike(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :])


def test_short_and_nameless_near_copies(spark):
    """Texts of five shingles against six, and rows without an id alike to each other or to a row that has one."""
    rows = [(10 * g + c, " ".join(f"g{g}w{k}" for k in range(9 + c))) for g in range(40) for c in range(2)]
    long = [f"n{i}" for i in range(100)]
    rows += [(None, " ".join([*long, "x"])), (None, " ".join([*long, "y", "z"])), (None, " ".join(f"g3w{k}" for k in range(11)))]
    kept = left_by_stage(spark, rows)
    assert sorted(d for d, _ in kept if d is not None) == [10 * g for g in range(40)]
    assert sum(d is None for d, _ in kept) == 1


def test_contaminated_go_and_others_stay(spark, stages):
    from penstock.llm.common import keyed
    from penstock.llm.decontaminate import contamination

    bad = {r.doc for r in contamination(keyed(stages[2]), spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
    assert bad and {r.doc_id for r in stages[3].collect()} == {r.doc_id for r in stages[2].collect()} - bad


def test_pseudonyms_keep_all(stages):
    before, after = ({r.doc_id: r.text for r in docs.collect()} for docs in stages[3:5])
    assert before.keys() == after.keys() and all(len(before[d]) == len(after[d]) for d in before)
    assert sum(before[d] != after[d] for d in before) > 3


def test_mix(stages):
    docs = {r.doc_id for r in stages[4].collect()}
    mixed = stages[5].collect()
    times = Counter(r.doc_id for r in mixed)
    assert set(times) <= docs and max(times.values()) <= 3
    assert {(r.doc_id, r.copy) for r in mixed} == {(d, k) for d, n in times.items() for k in range(1, n + 1)}


def test_run_is_the_stages(spark, stages):
    key = ["doc_id", "copy"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select(*key).collect())) == sorted(map(tuple, stages[-1].select(*key).collect()))


def test_odd_and_empty_tables(spark, odd):  # noqa: F811
    for rows in (odd, odd.where("false")):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            docs = staged(stage(spark, docs, SF), f"odd-{name}")
            assert set(rows.columns) <= set(docs.columns)
        ids = docs.select("doc_id").distinct().count()
        assert ids == 0 if rows is not odd else 0 < ids <= len({r[0] for r in ODD})
        assert docs.where(F.col("doc") != "x").count() == 0
