"""Rare words of hosts count however many words the pages have."""

import math
import random
from collections import Counter
from itertools import islice, product

from kinelake.llm import url_filter


def test_rare_host_word_among_many(spark, tmp_path):
    many = " ".join("".join(w) for w in islice(product("abcdefghijklmnop", repeat=4), 50_010))
    html = f"<p>{many} {many} big big big com com com zebrafish</p>"
    spark.createDataFrame([(1, "http://bigzebrafish.com/7", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    (row,) = url_filter.op1_url_filter(spark, str(tmp_path)).collect()
    assert row.words.split()[:2] == ["h:big", "h:zebrafish"]


def _splits(s):
    for bits in range(1 << max(0, len(s) - 1)):
        cuts = [0, *[i + 1 for i in range(len(s) - 1) if bits >> i & 1], len(s)]
        yield [s[a:z] for a, z in zip(cuts, cuts[1:])]


def test_segments_are_the_most_probable_of_all_splits():
    rng = random.Random(2)
    counts = {"".join(rng.choices("abc", k=rng.randrange(1, 5))): rng.randrange(1, 50) for _ in range(25)}
    total = sum(counts.values())
    weigh = lambda words: sum(math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10) for w in words)
    segment = url_filter.Segmenter(counts)
    for _ in range(300):
        s = "".join(rng.choices("abcd", k=rng.randrange(1, 11)))
        found = segment(s)
        assert "".join(found) == s and math.isclose(weigh(found), max(map(weigh, _splits(s))), rel_tol=1e-12)
    assert segment("") == [] and segment("z" * 300) == ["z" * 300]


def test_words_of_any_length(spark):
    long = "pneumonoultramicroscopicsilicovolcanoconiosis"
    counts = spark.createDataFrame([(long, 3), ("cheap", 9), ("pills", 9), ("e", 50)], "word string, n long")
    pieces = spark.createDataFrame([("cheappills",), (f"cheap{long}",), ("q" * 60,), ("0",)], "piece string")
    got = {r.piece: r.words for r in url_filter.segmented(pieces, counts).collect()}
    assert got == {"cheappills": ["cheap", "pills"], f"cheap{long}": ["cheap", long], "q" * 60: ["q" * 60], "0": ["0"]}


def test_labels_that_separate_give_both_verdicts(spark, tmp_path):
    bad, good = ["cheappills", "casinowin", "pillscasino", "wincheap"], ["gardennews", "newsmuseum", "museumgarden", "gardenpark"]
    words = "cheap pills casino win garden news museum park http com " * 20
    rows, labels = [], []
    for i in range(80):
        name = (bad if i % 2 else good)[i // 2 % 3]  # the fourth name of each is held out
        rows.append((i, f"http://{name}.com/x/{i}", f"<p>{words}</p>"))
        labels.append((i, 0 if i % 2 else 1, 0))
    rows += [(1000, f"https://{bad[3]}.com/a", None), (1001, f"https://{good[3]}.com/a", ""), (1001, f"https://{good[3]}.com/a", ""), (1002, None, "x"), (1003, "http://" + "cheappills" * 2000 + ".com/", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [(r.page_id, r.verdict, r.words, r.block_score) for r in url_filter.op1_url_filter(spark, str(tmp_path)).collect()]
    by_id = {g[0]: g for g in got}
    assert len(got) == len(rows) and by_id[1000][1:3] == ("block", "h:win h:cheap h:com p:a") and by_id[1001][1:3] == ("allow", "h:garden h:park h:com p:a")
    assert by_id[1002][2] == "" and by_id[1003][1] == "block" and by_id[1003][2].startswith("h:cheap h:pills h:cheap")
    # naive Bayes by hand
    tokens = {True: Counter(), False: Counter()}
    for i in range(80):
        tokens[bool(i % 2)].update(by_id[i][2].split())
    kinds = set(tokens[True]) | set(tokens[False])
    share = lambda t, c: math.log((tokens[c][t] + 1) / (sum(tokens[c].values()) + len(kinds) + 1))
    for page in (0, 1, 1000, 1001):
        logit = math.log(41 / 41) + sum(share(t, True) - share(t, False) for t in by_id[page][2].split() if t in kinds)
        assert math.isclose(by_id[page][3], 1 / (1 + math.exp(-logit)), rel_tol=1e-9)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert url_filter.op1_url_filter(spark, str(tmp_path)).count() == 0
