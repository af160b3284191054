"""The class-conditional models against a spelt-out version, and toxic phrases of ordinary words."""

import math
import random

import pytest

from penstock.llm.common import keyed
from penstock.llm.toxicity import DEVIATIONS, HEAD, Lower, fit, scored, training_rows


def corpus(seed=4, n=400):
    """Toxic texts hold an insult, a coined word with a telling head, or a phrase of words that are ordinary singly."""
    draw = random.Random(seed)
    ordinary = [f"word{chr(97 + i % 26)}{i}" for i in range(60)] + ["you", "go", "home", "now"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = [draw.choice(ordinary) for _ in range(draw.randint(15, 40))]
        if toxic:
            for some in (["Scumbag"], [f"vile{draw.randrange(10**6)}x"], ["go", "home"]):
                at = draw.randrange(len(words))
                words[at:at] = some
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    used = [(r.toxic, r.text.lower().split()) for r in training_rows(docs, marks).collect()]
    return docs, fit(docs, marks), used


class ByForce:
    """P(w | h) of class c, order by order, as the docstring of the module has it."""

    def __init__(self, used):
        self.pairs, self.contexts = ({}, {}), ({}, {})
        for c, words in used:
            around = ["", *words, ""]
            for pair in {(a, b) for a, b in zip(around[:-2], around[1:-1])}:
                self.pairs[c][pair] = self.pairs[c].get(pair, 0) + 1
            for word in set(words):
                i = around.index(word, 1)
                self.contexts[c].setdefault(word, set()).add((around[i - 1], around[i + 1]))
        self.vocabulary = set(self.contexts[0]) | set(self.contexts[1])
        self.counts = [{w: len(s) for w, s in side.items()} for side in self.contexts]
        self.taken = [{w: self.split(self.counts, c, w)[1] for w in self.vocabulary} for c in (0, 1)]
        self.heads = [{}, {}]
        for c in (0, 1):
            for w, n in self.taken[c].items():
                self.heads[c][w[:HEAD]] = self.heads[c].get(w[:HEAD], 0) + n

    @staticmethod
    def split(counts, c, x, only=None):
        """What of the count stays above the discount, and what the discount takes."""
        keys = [k for k in set(counts[0]) | set(counts[1]) if only is None or only(k)]
        totals = [sum(counts[d].get(k, 0) for k in keys) for d in (0, 1)]
        expected = (counts[0].get(x, 0) + counts[1].get(x, 0)) / sum(totals) * totals[c]
        n = counts[c].get(x, 0)
        above = max(0, n - expected - DEVIATIONS * math.sqrt(expected) - 0.5)
        return above / totals[c], n - above

    def left(self, counts, c):
        return 1 - sum(self.split(counts, c, x)[0] for x in set(counts[0]) | set(counts[1]))

    def head(self, c, head):
        shared = (sum(self.heads[d].get(head, 0) for d in (0, 1)) + 0.5) / (sum(sum(h.values()) for h in self.heads) + 0.5 * (len(set(self.heads[0]) | set(self.heads[1])) + 1))
        return self.split(self.heads, c, head)[0] + self.left(self.heads, c) * shared

    def word(self, c, word):
        given = (sum(t.get(word, 0) for t in self.taken) + 0.5) / (sum(h.get(word[:HEAD], 0) for h in self.heads) + 0.5 * (sum(w[:HEAD] == word[:HEAD] for w in self.vocabulary) + 1))
        return self.split(self.counts, c, word)[0] + self.left(self.counts, c) * self.head(c, word[:HEAD]) * given

    def after(self, c, before, word):
        same = [{b: n for (a, b), n in side.items() if a == before} for side in self.pairs]
        if not same[c]:
            return self.word(c, word)
        return self.split(same, c, word)[0] + self.left(same, c) * self.word(c, word)

    def ratio(self, words):
        return sum(math.log(self.after(1, a, b) / self.after(0, a, b)) for a, b in zip(["", *words], words))


def test_log_likelihoods_by_force(fitted):
    _, model, used = fitted
    plain = ByForce(used)
    unknown = [["never", "seen"], ["vile77x", "you", "go", "home"], ["scumbag"], [], ["go", "home", "go", "home", "vilest"]]
    for words in [words for _, words in used[:6]] + unknown:
        assert model.of(words) == pytest.approx(plain.ratio(words), abs=1e-9)
    assert model.words and model.heads and model.pairs


def test_probabilities_leave_no_mass_and_make_none(fitted):
    """Known words and a share for unknown ones add up to one, in both classes."""
    _, _, used = fitted
    plain = ByForce(used)
    lower = Lower({w: (plain.counts[1].get(w, 0), plain.counts[0].get(w, 0)) for w in plain.vocabulary})
    for c in (0, 1):
        known = sum(lower.word(w)[c] for w in plain.vocabulary)
        assert 0.9 < known < 1


def test_phrase_of_ordinary_words(fitted):
    """`go home` is toxic as a phrase; its words are not."""
    _, model, _ = fitted
    assert model.of(["go", "home"]) > 1 + abs(model.of(["home", "go"]))
    assert model.of(["vile31337x"]) > 1 and model.of(["Scumbag".lower()]) > 1


def test_ties_and_long_texts(spark, fitted):
    docs, model, _ = fitted
    long = spark.createDataFrame([(1, "worda0 " * 300_000 + "scumbag"), (2, "worda0 " * 300_000), (3, "scumbag vile1x go home"), (3, "scumbag vile1x go home"), (4, "SCUMBAG vile1x go home")], "doc_id long, text string")
    got = {}
    for r in scored(keyed(long), model).collect():
        got.setdefault(r.doc, set()).add((r.score, r.n_words))
    assert all(len(x) == 1 for x in got.values())
    (a,), (b,), (c,), (d,) = (got[i] for i in (1, 2, 3, 4))
    assert a[1] == 300_001 and abs(a[0] - b[0]) < 1e-3 and c == d and c[0] > 0.9 > 0.5 > b[0]
