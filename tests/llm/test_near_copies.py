"""The pipeline's near-duplicate stage against brute force on edited copies."""

import random
from itertools import combinations

import pytest

import corpus_pipeline
from kinelake.llm import near_copies

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _grams(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def _edited(rng, n_texts=60, copies=5):
    """Texts and copies with 0 to 12 of 200 words replaced: similarities from 0.4 to 1."""
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(n_texts):
        words = rng.choices(vocabulary, k=200)
        out.append(" ".join(words))
        for _ in range(copies):
            copy = words[:]
            for at in rng.sample(range(200), rng.randrange(1, 13)):
                copy[at] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    return out


def _brute(texts):
    grams, low = [_grams(t) for t in texts], list(range(len(texts)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        both = len(grams[i] & grams[j])
        if both and 5 * both >= 4 * (len(grams[i]) + len(grams[j]) - both):
            a, b = root(i), root(j)
            low[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("large", [near_copies.LARGE, 500])
def test_components_as_brute_force(spark, large):
    texts = _edited(random.Random(3))
    got = dict(near_copies.components(spark.createDataFrame(list(enumerate(texts)), "node long, text string"), large).collect())
    assert [got.get(i, i) for i in range(len(texts))] == _brute(texts)


def test_stage_drops_edited_copies(spark):
    texts = _edited(random.Random(4))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == sorted(set(_brute(texts)))
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_rows_that_share_an_id_stay_unless_their_texts_are_alike(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(3000)], k=50)) for _ in range(6)]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[2]), (None, texts[2]), (None, texts[3]), (2, texts[4]), (1, texts[4]), (3, texts[5]), (3, texts[5])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {(1, texts[0]), (1, texts[1]), (1, texts[2]), (None, texts[3]), (1, texts[4]), (3, texts[5])}
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 6
