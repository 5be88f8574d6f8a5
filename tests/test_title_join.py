"""The index of titles against all pairs."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from kinelake.operators import sessions

WORDS = ["symphony", "live", "berlin", "no", "ouverture", "aa", "b", "requiem", "교향곡", "mass", "in", "d", "final", "finale"]


def _titles(many):
    r = random.Random(7)
    out = {"a", "ab", "ba", "abc", "aaaa", "aaab", "x" * 210, "x" * 150 + " y" * 30}
    while len(out) < many:
        t = " ".join(r.choices(WORDS, k=r.randint(1, 6)))
        out.add(t)
        if r.random() < 0.5:
            at = r.randrange(len(t))
            out.add((t[:at] + r.choice(["", "z", "e "]) + t[at + 1 :]).strip() or "q")
    return sorted(out)


@pytest.mark.parametrize("similarity", [0.3, 0.6, 2 / 3, 0.7, 0.8, 0.9, 1.0])
def test_title_candidates_lose_no_pair(spark, similarity):
    titles = _titles(160)
    df = spark.createDataFrame([("c", i, t) for i, t in enumerate(titles)], "conductor string, low long, norm string")
    df = df.select("conductor", F.array(F.lit(5)).alias("nums"), "norm", "low", F.col("low").alias("high"), F.array().cast("array<string>").alias("composers"))
    got = [(r.low_a, r.low_b) for r in sessions.title_candidates(df, similarity).collect()]
    want = {(i, j) for j, b in enumerate(titles) for i, a in enumerate(titles[:j]) if max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) >= similarity}
    assert len(got) == len(set(got)) and want <= set(got)
    if similarity >= 0.8:
        assert len(got) < len(titles) * (len(titles) - 1) / 2 * 0.5


def test_title_edges_need_a_similarity(spark):
    df = spark.createDataFrame([], "conductor string, video_id long, title string")
    assert sessions.title_edges(df).count() == 0
    for s in (0.0, 1.5):
        with pytest.raises(ValueError):
            sessions.title_edges(df, s)
