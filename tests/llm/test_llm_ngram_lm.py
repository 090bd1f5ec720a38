"""The backoff automaton against a sequential walk over dictionaries and against the formula."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.llm import ngram_lm


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def tokens_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower(text)), None]


class Plain:
    """Counts in dictionaries, contexts as tuples; None ends a text, 0 begins it."""

    def __init__(self, texts, order, strength):
        self.order, self.k = order, strength
        self.counts, self.contexts = Counter(), Counter()
        for text in texts:
            run = [0, *tokens_of(text)]
            for i in range(1, len(run)):
                for m in range(order):
                    if i - m >= 0:
                        self.counts[tuple(run[i - m : i + 1])] += 1
                        self.contexts[tuple(run[i - m : i])] += 1
        self.words = self.contexts[()]
        self.types = sum(len(g) == 1 for g in self.counts)

    def single(self, word):
        return (self.counts[(word,)] + 0.5) / (self.words + 0.5 * (self.types + 1))

    def p(self, context, word):
        if not context:
            return self.single(word)
        return (self.counts[(*context, word)] + self.k * self.p(context[1:], word)) / (self.contexts[context] + self.k)

    def by_formula(self, text):
        run = [0, *tokens_of(text)]
        return sum(math.log10(self.p(tuple(run[max(i - self.order + 1, 0) : i]), run[i])) for i in range(1, len(run)))

    def by_walk(self, text):
        """One state, one word after the other, arcs and failure arcs."""
        state, total = (0,), 0.0
        for word in tokens_of(text):
            while state and not self.counts[(*state, word)]:
                total += math.log10(self.k / (self.contexts[state] + self.k))
                state = state[1:]
            total += math.log10(self.p(state, word))
            state = (*state, word)[-(self.order - 1) :]
            while state and not self.counts[state]:
                state = state[1:]
        return total

    def base(self, text):
        return sum(math.log10(self.single(w)) for w in tokens_of(text))


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "The", "the", "é", "x1", "...", "日本", "rare%d" % rng.randrange(400)])
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(word() for _ in range(rng.randrange(0, 40)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "a b a b " * 1500), (204, "É A b"), (205, "the the"), (205, "the the"), (None, "the a")]
    rows += [(300 + i, "copied words here " * 5) for i in range(50)]
    return rows


def split(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 != 1


def train():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 != 1


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_equal_formula_and_sequential_walk(spark, order):
    rows = corpus()
    model = Plain([t for d, t in rows if split(d)], order, 7.0)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, score int, _text string").repartition(3)
    # chunks and ranges of a few texts, so that counts come from many tasks
    got = ngram_lm.score(df, train(), order=order, strength=7.0, chunk_bytes=2000, range_bytes=900).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got) == sorted((d is None, d) for d, _ in rows)
    texts = dict(rows)
    for r in got:
        text = texts[r["doc_id"]]
        run = tokens_of(text)
        assert r["held_out"] == (not split(r["doc_id"])) and r["train_tokens"] == model.words
        assert r["n_tokens"] == len(run) and r["n_known"] == sum(model.counts[(w,)] > 0 for w in run)
        assert math.isclose(r["base_score"], model.base(text), rel_tol=1e-9)
        assert math.isclose(r["score"], model.by_formula(text), rel_tol=1e-9)
        assert math.isclose(r["score"], model.by_walk(text), rel_tol=1e-9)


def test_probabilities_sum_to_one():
    model = Plain([t for _, t in corpus()], 3, 7.0)
    words = {g[0] for g in model.counts if len(g) == 1}
    for context in [(), (0,), ("the",), ("a", "b"), ("日本", "the"), ("never", "seen")]:
        # all words and one share for those unseen
        assert math.isclose(sum(model.p(context, w) for w in words) + model.p(context, "unseen"), 1.0)


def test_lanes_do_not_change_scores():
    import pyarrow as pa

    texts = pa.array([" ".join(random.Random(i).choices("abcdef", k=i * 13)) for i in range(40)])
    run = ngram_lm.stream(texts, 3)
    held = []
    for size in (1, 2, 3):
        one = ngram_lm.hold(run, np.ones(run.starts[-1], bool), size, None)
        one.totals = np.where(np.arange(len(one.local)) % 3 == 0, 0, one.local) if size == 3 else one.local  # some arcs missing
        held.append(one)
    auto = ngram_lm.Automaton(run, held, ngram_lm.Corpus(1000, 7, 40), 5.0)
    whole = auto.scores(run.starts, lane=10**6)
    for lane in (3, 7, 64):
        assert (auto.scores(run.starts, lane=lane) == whole).all()


def test_packing_comes_back():
    rng = np.random.default_rng(2)
    for n in (1, 2, 1000):
        grams = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (ngram_lm.unpacked(ngram_lm.packed(grams), n, np.uint64) == grams).all()
        for kind in (np.uint32, np.int64):
            counts = rng.integers(0, 2**31, n).astype(kind)
            assert (ngram_lm.unpacked(ngram_lm.packed(counts), n, kind) == counts).all()


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert ngram_lm.score(df.limit(0), train()).count() == 0
    for r in ngram_lm.score(df, F.lit(False)).collect():
        assert r["held_out"] and r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] == 0 and r["base_score"] == 0


def test_the_model_learns_order(spark):
    rng = random.Random(1)
    follow = {w: rng.sample(range(200), 3) for w in range(200)}

    def text():
        w, out = rng.randrange(200), []
        for _ in range(60):
            out.append(f"w{w}")
            w = rng.choice(follow[w])
        return " ".join(out)

    df = spark.createDataFrame([(i, text()) for i in range(600)], "doc_id long, text string")
    got = ngram_lm.score(df, train()).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.6 * got[1]  # both negative
