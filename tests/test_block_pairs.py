"""Blocks of a class meet each other once, whatever their number."""

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from kinelake.operators import identity


def test_every_pair_of_a_class_meets_once(spark):
    rows = [(c, [float(i), 1.0], i) for c, n in ((1, 40), (2, 3), (None, 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "conductor int, v array<double>, k long")
    a, b = identity.blocks(df, "a", "k", 6), identity.blocks(df.where("k % 2 = 0"), "b", "k", 4)
    assert a.where("conductor = 1").count() > 3 and a.agg(F.sum(F.size("a_v"))).first()[0] == 43  # without the two rows of no class

    def partial(pair):
        assert np.stack(pair.a_m)[:, 0].astype(int).tolist() == list(pair.a_v)
        return pd.DataFrame([(i, j) for i in pair.a_v for j in pair.b_v], columns=["i", "j"])

    got = Counter((r.conductor, r.i, r.j) for r in identity.block_pairs(a, b, partial, "i long, j long").collect())
    assert got == Counter((c, i, j) for c, n in ((1, 40), (2, 3)) for i in range(n) for j in range(0, n, 2))


def test_identity_on_empty_tables(spark):
    faces = spark.createDataFrame([], "conductor int, video_id long, vec_id long, emb array<double>, score double")
    assert identity.match_scores(faces, faces).count() == identity.cross_video_cluster(faces, 0.1).count() == identity.select_diverse(faces, 3, 0.1).count() == 0
