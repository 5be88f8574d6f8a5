"""URL filter: hand-written rules first, then unigram Viterbi segmentation and multinomial naive Bayes.

Runs of letters in host and path (``besthotelsdeals``) are split into words by the most probable unigram path; a
multinomial naive Bayes model over the words of host and path decides what no rule covers. Words, pieces, tokens and odds
are tables that are joined, whatever their number; only keys that are hot (fewer than components.HOT_SHARE of them) are broadcast.
Where the classes can't be told apart, the larger prior decides.

Defined results: a null url, or one without ``://``, has empty host and path and no tokens, and gets the class with the
larger prior; rows keep their multiplicity; only the id and url columns are read, so extra columns can't clash; an empty
table gives an empty result; with no labelled rows the model allows everything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.llm.components import join_hot
from kinelake.runtime import cut, ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this number are part of the plan as literals; more of them are joined on host suffixes.
INLINE_RULES = 256
#: Words up to this length are looked up among all substrings of a piece, longer ones through their first letters.
SHORT = 24
#: The prior's logarithm where nothing is labelled: allow.
NO_LABELS = -1.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def parse_rule(verdict: str, rule: str) -> tuple[str, str, str, str]:
    """(verdict, rule, host, path): a rule is a host, a slash and a path prefix."""
    host, slash, path = rule.partition("/")
    return verdict, rule, host.translate(str.maketrans(UPPER, LOWER)), slash + path


def apply_rules(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict``: the longest rule that fits; of equal ones that with the longer host, then the smaller string; of a rule listed twice, the first.

    urls needs columns host and path. A rule fits its host and all subdomains if the path starts with the rule's.
    """
    parsed = list({r[1]: parse_rule(*r) for r in reversed(rules)}.values())
    if not parsed:
        return urls.withColumn("rule", F.lit(None).cast("string")).withColumn("rule_verdict", F.lit(None).cast("string"))
    if len(parsed) <= INLINE_RULES:
        order = sorted(parsed, key=lambda r: (-len(r[1]), -len(r[2]), r[1]))
        fits = [(F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h)) for _, _, h, _ in order]
        fits = [f & F.startswith(F.col("path"), F.lit(p)) for f, (_, _, _, p) in zip(fits, order, strict=True)]
        chosen = F.coalesce(*[F.when(f, F.struct(F.lit(r).alias("rule"), F.lit(v).alias("rule_verdict"))) for f, (v, r, _, _) in zip(fits, order, strict=True)])
        return urls.withColumn("_chosen", chosen).select(*urls.columns, "_chosen.rule", "_chosen.rule_verdict")
    spark = urls.sparkSession
    table = spark.createDataFrame(parsed, "rule_verdict string, rule string, rule_host string, rule_path string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keyed = urls.withColumn("_row", F.monotonically_increasing_id())
    # distinct (host, path) keep hot hosts small before the join
    pairs = keyed.select("host", "path").distinct().withColumn("rule_host", F.explode(suffixes))
    best = (
        pairs.join(table, "rule_host").where(F.startswith("path", F.col("rule_path")))
        .groupBy("host", "path")
        .agg(F.min_by(F.struct("rule", "rule_verdict"), F.struct(-F.length("rule"), -F.length("rule_host"), "rule")).alias("_chosen"))
    )
    return keyed.drop("_row").join(best, ["host", "path"], "left").select(*urls.columns, "_chosen.rule", "_chosen.rule_verdict")


class Segmenter:
    """Most probable split of a string of letters into words under a unigram model.

    A word of n letters that isn't known has probability 10 / (total * 10 ** n), whatever its length, so that unknown
    strings stay whole only if no known words fill them; no known word is less probable than that. Equal probabilities go
    to the split whose last word is longer.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = max(1, sum(counts.values()) if total is None else total)
        self.log = {w: math.log(c / total) for w, c in counts.items()}
        self.lengths = sorted({len(w) for w in counts}, reverse=True)
        self.unknown = math.log(10 / total)

    def __call__(self, s: str) -> list[str]:
        best, back, ten, log = [0.0], [0], math.log(10), self.log
        far, since = 0.0, 0  # where an unknown word that ends here or later begins best
        for end in range(1, len(s) + 1):
            top, at = best[since] + (self.unknown - (end - since) * ten), since
            for n in self.lengths:
                if n <= end and (known := log.get(s[end - n : end])) is not None:
                    p = best[end - n] + known
                    if p > top or (p == top and end - n < at):
                        top, at = p, end - n
            best.append(top)
            back.append(at)
            if top + end * ten > far:
                far, since = top + end * ten, end
        words, end = [], len(s)
        while end:
            words.append(s[back[end] : end])
            end = back[end]
        return words[::-1]


def word_counts(corpus: DataFrame, text_col: str) -> DataFrame:
    """(word, n) of all words of a-z in the whole corpus, markup skipped, A-Z lower-cased."""
    plain = F.regexp_replace(F.lower(F.col(text_col)), r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    words = corpus.select(F.explode(F.regexp_extract_all(plain, F.lit(r"[a-z]++"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def pieces_of(host: Column, path: Column) -> Column:
    """array<struct<mark, piece>>: runs of letters of host (mark ``h:``) and path (``p:``) in order; every run of digits is the piece ``0``."""
    runs = lambda mark, text: F.transform(
        F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]++|[0-9]++"), F.lit(0)),
        lambda x: F.struct(F.lit(mark).alias("mark"), F.when(x.rlike("^[0-9]"), F.lit("0")).otherwise(x).alias("piece")),
    )
    return F.concat(runs("h:", host), runs("p:", path))


def segmented(pieces: DataFrame, counts: DataFrame) -> DataFrame:
    """(piece, words) of the distinct pieces(piece); counts(word, n).

    Known words are found by joins, so that no table of words is ever sent whole: up to SHORT letters through all
    substrings of the pieces, longer ones through their first SHORT letters.
    """
    ship(pieces.sparkSession)
    starts = pieces.select("piece", F.explode(F.sequence(F.lit(1), F.length("piece"))).alias("at"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(SHORT), F.length("piece") - F.col("at") + 1))
    parts = starts.select("piece", F.explode(F.transform(lengths, lambda n: F.substring(F.col("piece"), F.col("at"), n))).alias("word")).distinct()
    short = parts.join(counts.where(F.length("word") <= SHORT), "word").select("piece", "word", "n")
    grams = starts.where(F.length("piece") - F.col("at") >= SHORT).select("piece", "at", F.substring(F.col("piece"), F.col("at"), F.lit(SHORT)).alias("gram"))
    more = counts.where(F.length("word") > SHORT).withColumn("gram", F.substring("word", 1, SHORT))
    long = grams.join(more, "gram").where(F.substring(F.col("piece"), F.col("at"), F.length("word")) == F.col("word")).select("piece", "word", "n").distinct()
    known = short.unionByName(long).groupBy("piece").agg(F.collect_list("word").alias("known"), F.collect_list("n").alias("ns"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))  # one row
    ready = pieces.join(known, "piece", "left").join(F.broadcast(total), F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*[b.column(i).to_pylist() for i in range(4)], strict=True)
            words = [["0"] if piece == "0" else Segmenter(dict(zip(known or (), ns or (), strict=True)), total)(piece) for piece, known, ns, total in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string()))], names=["piece", "words"])

    return ready.select("piece", "known", "ns", "total").mapInArrow(run, "piece string, words array<string>")


def train_bayes(tokens: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Multinomial naive Bayes with add-one smoothing: (token, odds) and one row (prior).

    tokens(token, bad, good) has each token once with its occurrences in blocked and in allowed urls, rows(block) a row
    per labelled url.
    """
    per = cut(tokens)
    size = per.agg(F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("all_bad"), F.coalesce(F.sum("good"), F.lit(0)).alias("all_good"))  # one row
    share = lambda c: F.log((F.col(c) + 1) / (F.col(f"all_{c}") + F.col("n") + 1))
    odds = per.join(F.broadcast(size), F.lit(True)).select("token", (share("bad") - share("good")).alias("odds"))
    bad, good = F.count_if("block"), F.count_if(~F.col("block"))
    return odds, rows.agg(F.when(bad + good > 0, F.log((bad + 1) / (good + 1))).otherwise(F.lit(NO_LABELS)).alias("prior"))


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str]], counts: DataFrame, labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """(id, host, path, rule, verdict, block_score, words) of every url; the rule's verdict, else the model's.

    counts(word, n) are the corpus's words; labels(doc_id, block) judge the documents that urls name by the first whole
    number in their path, and are what the model learns from.
    """
    ship(pages.sparkSession)
    number = F.try_to_number(F.regexp_extract("path", r"/([0-9]{1,18})(?:\D|$)", 1), F.lit("9" * 18)).cast("long")
    urls = pages.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.coalesce(host_of(F.col(url_col)), F.lit("")).alias("host"), F.coalesce(path_of(F.col(url_col)), F.lit("")).alias("path"))
    urls = cut(urls)
    exploded = urls.select("_row", F.posexplode(pieces_of(F.col("host"), F.col("path"))).alias("pos", "p")).select("_row", "pos", "p.mark", "p.piece")
    kinds = cut(exploded.select("mark", "piece").distinct())
    words = cut(segmented(kinds.select("piece").distinct(), counts))
    tokens = kinds.join(words, "piece").select("mark", "piece", F.posexplode(F.transform("words", lambda w: F.concat("mark", w))).alias("at", "token"))
    scores = tokens.select("mark", "piece", "at", "token", F.lit(0.0).alias("odds"))
    prior = pages.sparkSession.range(1).select(F.lit(NO_LABELS).alias("prior"))
    if labels is not None:
        judged = cut(urls.select("_row", number.alias("doc_id")).join(labels.select("doc_id", "block"), "doc_id").select("_row", "block"))
        by_piece = judged.join(exploded, "_row").groupBy("mark", "piece").agg(F.count_if("block").alias("bad"), F.count_if(~F.col("block")).alias("good"))
        weighed = by_piece.join(tokens, ["mark", "piece"])
        odds, prior = train_bayes(weighed.groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), judged)
        scores = tokens.join(odds, "token", "left").select("mark", "piece", "at", "token", F.coalesce("odds", F.lit(0.0)).alias("odds"))
    per_piece = cut(scores.groupBy("mark", "piece").agg(F.array_sort(F.collect_list(F.struct("at", "token", "odds"))).alias("tokens")))
    found = join_hot(exploded, per_piece, ["mark", "piece"]).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("pos", "tokens"))).alias("all"))
    flat = F.flatten(F.transform("all", lambda p: p["tokens"]))
    found = found.select("_row", F.array_join(F.transform(flat, lambda t: t["token"]), " ").alias("words"), F.aggregate(flat, F.lit(0.0), lambda s, t: s + t["odds"]).alias("logit"))
    scored = urls.join(found, "_row", "left").join(F.broadcast(prior), F.lit(True))
    logit = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("prior") + F.coalesce("logit", F.lit(0.0))))
    scored = scored.select("_id", "host", "path", (1 / (1 + F.exp(-logit))).alias("block_score"), F.coalesce("words", F.lit("")).alias("words"))
    by_model = F.when(F.col("block_score") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return apply_rules(scored, rules).select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("rule_verdict", by_model).alias("verdict"), "block_score", "words")


#: The rules of the query.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """All pages. The words are those of the pages; the labels those of the document that a url's number names (toxic or of low quality: block)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    block = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    return filter_urls(pages, RULES, cut(word_counts(pages, "html")), labels.select("doc_id", block.alias("block")))
