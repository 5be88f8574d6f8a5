"""The corpus operators against brute force, round trips, oracles and odd rows."""

import glob
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinelake.llm import bpe, chat_tree, components, langid, mixing, mtree, pii, queries, simhash, suffix_dedup, transport, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t", "a", "word " * 4000, "ü😀 x", "same text here and there " * 5, "same text here and there " * 5]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 3 else None, t, None if i == 4 else "en", [None, "s", "s", "t"][i % 4], None) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, DOCS).withColumn("size", F.lit(1)).withColumn("fp", F.lit("x"))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    c.register("got", queries.queries()[name](spark, SF).toArrow())
    c.execute(f"CREATE TABLE want AS {queries.oracle_sql()[name]}")
    columns = ", ".join(f'"{r[0]}"' for r in c.execute("DESCRIBE want").fetchall())
    for a, b in (("want", "got"), ("got", "want")):
        assert c.execute(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}").fetchall() == []


def test_rules_and_urls(spark):
    urls = [None, "no scheme", "HTTP://A.Example.COM/en/7x?q#f", "http://example.com/en/8", "http://xexample.com/en/7", "http://net", "http://m.example.net/de/81", "http://a.org/es/", "ftp://a.b.net/de/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    df = df.withColumn("host", F.lit("x")).withColumn("words", F.lit(1)).withColumn("_row", F.lit(2))
    counts = spark.createDataFrame([("best", 5), ("hotels", 5), ("deals", 5)], "word string, n long")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, url_filter.RULES, counts).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[3][2:] == ("com/en/", "block") and got[4][2:] == ("com/en/", "block") and got[5] == ("net", "", None, "allow")
    assert got[6][2:] == ("example.net/de/8", "block") and got[7][2:] == ("org/es/", "block") and got[8][2:] == ("net/de/", "allow")
    many = [*url_filter.RULES, *[("block", f"h{i}.zz/") for i in range(300)]]
    assert {r.page_id: r.rule for r in url_filter.filter_urls(df, many, counts).collect()} == {k: v[2] for k, v in got.items()}
    for twice in ([("allow", "org/"), ("block", "org/")], [*[("block", f"h{i}.zz/") for i in range(300)], ("allow", "org/"), ("block", "org/")]):
        assert {r.verdict for r in url_filter.filter_urls(df, twice, counts).where("rule = 'org/'").collect()} == {"allow"}
    assert url_filter.filter_urls(df.limit(0), url_filter.RULES, counts).count() == 0


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", chat_tree.TRICKY), (2, 0, "user", "hi"), (2, 1, "assistant", "\\"), (3, 0, None, None), (None, 0, "a:b\n", "</turn>\n### User: x"), (4, None, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    packs = chat_tree.pack_tree(df)
    back = {r.conv_id: ([tuple(t) for t in r.turns], r.loss) for r in chat_tree.read_conversations(packs).collect()}
    assert back[1] == ([("user", "hi"), ("assistant", chat_tree.TRICKY)], [chat_tree.TRICKY])
    assert back[3] == ([("", "")], []) and back[None] == ([("a:b\n", "</turn>\n### User: x")], []) and len(back) == 5
    shared = chat_tree.format_turn("user", "hi")[0]
    assert sum(r.text.count(shared) for r in packs.collect()) <= 2 and len(back[2][0]) == 2
    assert chat_tree.pack_tree(df.limit(0)).count() == 0


def _chat_digests(rows):
    """What each conversation reads back as, from its rows alone."""
    held = {}
    for c, turn, role, text in rows:
        held.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: ([(r, t) for *_, r, t in sorted(x)], [t for *_, r, t in sorted(x) if r == "assistant" and t]) for c, x in held.items()}


@pytest.mark.parametrize("pack_chars", [chat_tree.PACK_CHARS, 200])
def test_chat_packs_and_positions(spark, pack_chars):
    rng = random.Random(2)
    rows = [(c, t, ("user", "assistant")[t % 2], rng.choice(["hi", "\\", "### x", "w" * 90])) for c in range(60) for t in range(rng.randrange(1, 5))]
    rows += [(100, 0, "user", "twice"), (100, 0, "user", "twice"), (101, 0, "user", "long " * 60_000), (101, 1, "assistant", "é😀" * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("path", F.lit("x"))
    packs = chat_tree.pack_tree(df, pack_chars, partitions=3)
    held = packs.collect()
    assert (len(held) > 5) == (pack_chars == 200) or len(held) <= 3
    back = {r.conv_id: ([tuple(t) for t in r.turns], r.loss) for r in chat_tree.read_conversations(packs).collect()}
    assert back == _chat_digests(rows)
    positions = {r.pack_id: r.positions for r in chat_tree.token_positions(packs).collect()}
    for p in held:
        assert len(positions[p.pack_id]) == len(p.text)
        for leaf in p.leaves:  # a conversation's own tokens count up from 0
            assert [x for n in leaf.path for x in positions[p.pack_id][p.nodes[n].start : p.nodes[n].end]] == list(range(sum(p.nodes[n].end - p.nodes[n].start for n in leaf.path)))
        roots = [p.text[n.start : n.end] for n in p.nodes if n.parent == -1]
        assert len(roots) == len(set(roots))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (51, 52), (50, 52), (60, 60)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 31)) and got[51] == got[52] == 50


@pytest.mark.parametrize("split_at", [simhash.SPLIT_AT, 3])
def test_simhash_links_as_brute_force(spark, split_at):
    random.seed(3)
    base = [random.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << random.randrange(64) for _ in range(random.randrange(6))) & (2**64 - 1) for b in base for _ in range(8)} | {0, 1})
    signed = [int(np.uint64(x & (2**64 - 1)).view(np.int64)) for x in fps]
    found = components.connected_components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), split_at=split_at)).collect()
    label = {s: s for s in signed} | {r.node: r.component for r in found}
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if bin(a ^ fps[j]).count("1") <= 4:
                parent[root(i)] = root(j)
    want = {}
    for i, s in enumerate(signed):
        want.setdefault(root(i), set()).add(s)
    have = {}
    for s, c in label.items():
        have.setdefault(c, set()).add(s)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_simhash_odd_rows(spark, odd):
    rows = {(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(odd).collect()}
    assert {(0, 0, 0), (1, 0, 0), (2, 0, 0)} <= rows and len(rows) == 8 and sum(r[2] == 6 for r in rows) == 2
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_pii(spark):
    text = "é mail a@b.co+x@y.org card 4111 1111 1111 1111 no 4111111111111112 ip 10.0.0.255 300.1.1.1 call +44 (20) 7946-0958. iban GB82 WEST 1234 5698 7654 32; ssn 123-45-6789 " + "9" * 30000 + " " + "a" * 30000
    df = spark.createDataFrame([(1, text), (2, None), (3, "123-45-6789")], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, text[s.start : s.end]) for s in r.pii_spans] for r in pii.find_pii(df).collect()}
    kinds = [("email", "a@b.co"), ("email", "+x@y.org"), ("card", "4111 1111 1111 1111"), ("ip", "10.0.0.255"), ("phone", "+44 (20) 7946-0958"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("ssn", "123-45-6789")]
    assert [x for x in got[1] if x in kinds] == kinds and got[2] == [] and got[3] == []
    clean = pii.find_pii(df).select(pii.redacted(F.col("text"), F.col("pii_spans")).alias("t")).first().t
    assert clean.startswith("é mail <EMAIL><EMAIL> card <CARD> no ")


def test_pii_odd_rows(spark, odd):
    clash = odd.withColumn("pii_spans", F.lit("mine")).withColumn("start", F.lit(1))
    rows = pii.find_pii(clash)
    assert rows.count() == len(ODD) and rows.columns == clash.columns and dict(rows.dtypes)["pii_spans"].startswith("array")
    assert pii.find_pii(clash.limit(0)).count() == 0
    both = spark.createDataFrame([(1, "abc 4111111111111111@x.yz")], "doc_id long, text string")
    spans = [(s.kind, s.start, s.end) for s in pii.find_pii(both).first().pii_spans]
    assert spans == [("email", 4, 25), ("card", 4, 20)]  # of one start: in the order of the kinds
    assert pii.find_pii(both).select(pii.redacted(F.col("text"), F.col("pii_spans")).alias("t")).first().t == "abc <EMAIL>"


def test_pii_base_as_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for r in pii.find_pii(docs).collect():
        want = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text or "")]
        assert [(s.start, s.end) for s in r.pii_spans if s.kind == "email"] == want


def test_mixing_odd_rows(spark, odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 8 and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert mixing.mix(odd.limit(0)).count() == 0
    text = mixing.repetitions(spark.createDataFrame([(1, " a  b\nc ", 3, 5)], "doc_id long, text string, size long, taken long")).collect()
    assert sorted(r.text for r in text) == [" a  b", " a  b\nc "]


def test_mixing_takes_every_word_of_ties(spark):
    rows = [(7, "word", "a")] * 999 + [(8, "two words", None)] * 50 + [(8, "else here", None)] * 51 + [(i, "x " * (1 + i % 5), "b") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    for keep in ((), ("text",)):
        got = mixing.mix(docs, keep=keep).collect()
        assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r["size"] for r in got)
        for source in ("a", "b", None):
            mine = [r for r in got if r.source == source]
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.5
    again = mixing.mix(docs.repartition(3), keep=("text",)).collect()
    count = lambda rs: sorted((r.doc_id, r.text, r.taken) for r in rs)
    assert count(again) == count(got)
    alone = mixing.mix(docs.where("source = 'a'")).collect()
    assert sum(r.taken for r in alone) == 1499


def test_redaction_of_many_spans(spark):
    text = "é " + "a.b@c.de, " * 400 + "end"
    docs = spark.createDataFrame([(1, text), (2, "none"), (3, None), (4, "a.b@c.de" * 3)], "doc_id long, text string")
    got = {r.doc_id: r.out for r in pii.find_pii(docs).select("doc_id", pii.redacted(F.col("text"), F.col("pii_spans")).alias("out")).collect()}
    assert got[1] == "é " + "<EMAIL>, " * 400 + "end" and got[2] == "none" and got[3] is None
    kinds = "array<struct<kind:string,start:int,end:int>>"
    random.seed(8)
    rows = []
    for n in (1, 3, 64, 65, 200):
        starts = sorted(random.randrange(300) for _ in range(n))
        rows.append(("".join(random.choice("aé😀z") for _ in range(330)), [(random.choice("kl"), a, a + random.randrange(1, 12)) for a in starts]))
    found = spark.createDataFrame(rows, f"text string, spans {kinds}")
    for block in (1, 4, 64):
        for (t, spans), r in zip(rows, found.select("text", pii.redacted(F.col("text"), F.col("spans"), block).alias("out")).collect(), strict=True):
            out, at = "", 0
            for kind, a, z in spans:
                if a >= at:
                    out += t[at:a] + f"<{kind.upper()}>"
                at = max(at, z)
            assert r.out == out + t[at:]


def test_bpe_tells_vocabularies_of_one_size_apart(tmp_path):
    import json

    alphabet = {c: i for i, c in enumerate(sorted(bpe.byte_alphabet(), key=bpe.byte_alphabet().get))}
    found = []
    for number, merges in enumerate((["a b", "c d"], ["c d", "a b"], ["a c", "b d"])):
        vocab = alphabet | {m.replace(" ", ""): 256 + i for i, m in enumerate(merges)}
        path = tmp_path / f"{number}.json"
        path.write_text(json.dumps({"added_tokens": [], "model": {"vocab": vocab, "merges": merges}}))
        tables = bpe.load_tables(str(path))
        shared = type("Shared", (), {"value": tables})
        ids = bpe._encoder(shared, True).encode_all(["abcd acbd"])[0].tolist()
        assert ids == bpe.Encoder(tables, True).encode_all(["abcd acbd"])[0].tolist()
        found.append(tuple(ids))
    assert len(set(found)) == 3


def test_bpe_as_the_library(spark, odd):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.default_vocabulary()
    tables, library = bpe.load_tables(path), tokenizers.Tokenizer.from_file(path)
    encoder = bpe.Encoder(tables)
    random.seed(5)
    pool = [*"aaabbeett  '' \n\t.,!?0123éßñ中日😀\x85　", "<|endoftext|>", "'ll", " the", "  "]
    for text in ["".join(random.choices(pool, k=random.randrange(30))) for _ in range(3000)]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text).tolist() == ids
        assert bpe.decode(ids, tables["token"]) == library.decode(ids, skip_special_tokens=False)
    assert {r.doc_id: list(r.ids) for r in bpe.encode_texts(odd, tables).collect()}[0] == []
    want = {}
    for r in odd.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    clash = odd.withColumn("ids", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    assert {r.doc_id: tuple(r)[1:] for r in bpe.encode_digests(clash, tables).collect()} == want
    assert bpe.encode_digests(odd.limit(0), tables).count() == bpe.encode_texts(odd.limit(0), tables).count() == 0


@pytest.mark.parametrize("chunk", [bpe.CHUNK, 7])
def test_bpe_stretches_and_caches(monkeypatch, chunk):
    tokenizers = pytest.importorskip("tokenizers")
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    monkeypatch.setattr(bpe, "CACHE", 50)
    path = bpe.default_vocabulary()
    encoder, library = bpe.Encoder(bpe.load_tables(path)), tokenizers.Tokenizer.from_file(path)
    random.seed(6)
    pool = [*"aaabbeett  '' \n\t.,!?0123éß中😀\x85\u3000\x1c\x1f", "<|endoftext|>", "'ll", " the", " ", " ", " "]
    texts = ["".join(random.choices(pool, k=random.randrange(80))) for _ in range(1500)] + ["word and other " * 3000, "a" * 20000, " " * 500]
    for text, ids in zip(texts, encoder.encode_all(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_every_code_point():
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.default_vocabulary()
    encoder, library = bpe.Encoder(bpe.load_tables(path)), tokenizers.Tokenizer.from_file(path)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b {c} x" for c in points[at : at + 4096]) for at in range(0, len(points), 4096)]
    for ids, want in zip(encoder.encode_all(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == want.ids


def test_mtree_prunes_and_is_exact():
    random = np.random.default_rng(1)
    x = np.concatenate([random.normal(c, 20, (200, 4)) for c in (0, 500, -500, 900)]).astype(np.int64)
    tree, seen = mtree.build(np.arange(len(x)), x), [0]
    for q in (5, 250, 777):
        want = sorted((-int(v), k) for k, v in enumerate(x @ x[q]))[:10]
        assert [(-s, i) for s, i in mtree.search(tree, x[q], 10, seen)] == want
    assert seen[0] < 3 * len(x)


@pytest.mark.parametrize("scale", [10, 1 << 27])
def test_mtree_batches_as_brute_force(scale):
    random = np.random.default_rng(2)
    x = np.concatenate([random.integers(-scale, scale, (300, 8)), np.zeros((5, 8), np.int64), np.repeat(random.integers(-scale, scale, (1, 8)), 200, axis=0)])
    ids = random.integers(0, 400, len(x))
    q = np.concatenate([x[:50], random.integers(-scale, scale, (30, 6)) @ np.eye(6, 8, dtype=np.int64)])
    scores, found = np.full((len(q), 7), mtree.NONE), np.full((len(q), 7), np.iinfo(np.int64).max)
    for part in np.array_split(np.arange(len(x)), 3):
        mtree.search_all(mtree.build(ids[part], x[part], page=16), q, scores, found)
    for i, v in enumerate(q):
        want = sorted((-int(p), int(k)) for p, k in zip(x @ v, ids))[:7]
        assert list(zip((-scores[i]).tolist(), found[i].tolist())) == want


def _nearest(rows, k):
    """(query_id, rank, vec_id, score) by brute force; rows of (id, whole vector)."""
    out = []
    for a, (query, q) in enumerate(rows):
        if query % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v)), i) for b, (i, v) in enumerate(rows) if a != b)[:k]
            out += [(query, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("query_bytes", [mtree.QUERY_BYTES, 40])
def test_mtree_odd_rows(spark, query_bytes):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.0]), (0, [0.5, 0.0]), (1, [1.0, None]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0]), (5, [1.0, 0.0]), (6, []), (100, [0.5, 2.0]), (200, []), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("v", F.lit(1))
    v = mtree.integer_vectors(df, "vec_id", "embedding")
    fine = [(i, [int(1024 * x) for x in e]) for i, e in rows if i not in (1, 2, 3, None)]
    for k in (3, 10):
        got = mtree.top_k(mtree.index(v, shard_rows=3), v.where("id % 100 = 0"), k, query_bytes)
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == _nearest(fine, k)
    none = v.limit(0)
    assert mtree.top_k(mtree.index(none), none, 10).count() == 0
    with pytest.raises(Exception, match="63 bits"):
        mtree.integer_vectors(spark.createDataFrame([(1, [3e9, 0.0])], "vec_id long, embedding array<float>"), "vec_id", "embedding").collect()


def _kept_by_brute_force(rows):
    """(id, n_bytes, n_removed, n_spans, kept) of each row; null ids are larger than all others."""
    rank = lambda i: (i is None, i or 0)
    least, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - 49):
            least[b[j : j + 50]] = min(least.get(b[j : j + 50], (True, 1)), rank(i))
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for j in range(len(b) - 49):
            if least[b[j : j + 50]] < rank(i):
                gone[j : j + 50] = [True] * 50
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def _passages(n=60):
    random.seed(9)
    passages = ["".join(random.choices("abcde ", k=120)) for _ in range(6)]
    return ["".join(random.choices("abcde ", k=random.randrange(80))) + random.choice(passages)[random.randrange(40) :] + "x" * random.randrange(70) for _ in range(n)] + [None, "", "ti " * 200, "ti " * 300]


def _deduplicated(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("shard", F.lit(1)).withColumn("kept", F.lit(0))
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.deduplicate(df, **sizes).collect()), key=str)


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 3000, "array_bytes": 900}, {"shard_bytes": 1500, "array_bytes": 900, "hot_shards": 1}])
def test_suffix_dedup_as_brute_force(spark, sizes):
    rows = list(enumerate(_passages()))
    assert _deduplicated(spark, rows, **sizes) == _kept_by_brute_force(rows)
    texts = _passages(30)
    odd = [(None if i % 3 == 0 else i % 7, t) for i, t in enumerate(texts)] + [(None, texts[1]), (2, texts[1]), (2, texts[1])]
    assert _deduplicated(spark, odd, **sizes) == _kept_by_brute_force(odd)
    assert suffix_dedup.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_dedup_does_not_trust_hashes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "_slice_hashes", lambda text, start, size: np.zeros(len(start), np.uint64))
    monkeypatch.setattr(suffix_dedup, "window_keys", lambda text, second=False: np.zeros(len(text) - 49, np.uint64))
    shards = [[(4 * i + s, t) for i, t in enumerate(_passages(20)[s::4])] for s in range(4)]
    tables = [pa.table({"id": pa.array([i for i, _ in x], pa.int64()), "text": [t for _, t in x], "shard": pa.array([s] * len(x), pa.int32())}) for s, x in enumerate(shards)]
    sent = suffix_dedup.pa.concat_tables([suffix_dedup._send_keys(t, 1) for t in tables])
    flagged = suffix_dedup._repeated(sent, 100)
    of = lambda table, s: table.filter(pa.compute.equal(table.column("shard"), s))
    pieces = pa.concat_tables([suffix_dedup._within(t, of(flagged, s), 1) for s, t in enumerate(tables)])
    spans = suffix_dedup._across(pieces, 1 << 20)
    got = [tuple(r.values()) for s, t in enumerate(tables) for r in suffix_dedup._removed(t, of(spans, s)).to_pylist()]
    assert sorted(got, key=str) == _kept_by_brute_force([r for x in shards for r in x])


def test_suffix_dedup_shard_compares_what_its_documents_share(monkeypatch):
    """Strings that only other shards have too go to their buckets without a suffix array here."""
    import pyarrow as pa

    random.seed(4)
    own = ["".join(random.choices("abcdefgh ", k=400)) for _ in range(12)]
    shared = "".join(random.choices("abcdefgh ", k=90))
    made = []
    monkeypatch.setattr(suffix_dedup, "Shard", lambda text, *more, f=suffix_dedup.Shard: made.append(len(text)) or f(text, *more))
    for inside, most in (("", 0), (shared, 4 * 190)):  # its own strings of a shared key reach into what surrounds them
        texts = [t + inside * (i < 2) + t[::-1] for i, t in enumerate(own)]
        shards = [[(2 * i + s, t) for i, t in enumerate(texts)] for s in range(2)]
        tables = [pa.table({"id": pa.array([i for i, _ in x], pa.int64()), "text": [t for _, t in x], "shard": pa.array([s] * len(x), pa.int32())}) for s, x in enumerate(shards)]
        flagged = suffix_dedup._repeated(pa.concat_tables([suffix_dedup._send_keys(t, 1) for t in tables]), 100)
        of = lambda table, s: table.filter(pa.compute.equal(table.column("shard"), s))
        made.clear()
        pieces = pa.concat_tables([suffix_dedup._within(t, of(flagged, s), 1) for s, t in enumerate(tables)])
        assert sum(made) <= most and bool(made) == bool(inside)
        spans = suffix_dedup._across(pieces, 1 << 20)
        got = [tuple(r.values()) for s, t in enumerate(tables) for r in suffix_dedup._removed(t, of(spans, s)).to_pylist()]
        assert sorted(got, key=str) == _kept_by_brute_force([r for x in shards for r in x])


def test_suffix_dedup_sends_no_more_rows_than_keys():
    import pyarrow as pa

    texts = _passages(200)
    table = pa.table({"id": pa.array(range(len(texts)), pa.int64()), "text": texts, "shard": pa.array([0] * len(texts), pa.int32())})
    keys = len(np.unique(suffix_dedup.Texts(table).runs()[2]))
    assert suffix_dedup._send_keys(table, 10).num_rows == 10
    assert 0.9 * keys < suffix_dedup._send_keys(table, 1 << 30).num_rows <= keys


def test_transport_round_trip():
    for n in (0, 1, 63, 150, 160, 161, 170, 184, 4096, 4097, 40000):
        payload = random.Random(n).randbytes(n)
        stream = transport.mux(payload)
        d = transport.demux(stream)
        assert d["payload"] == payload and d["counter_errors"] == d["crc_errors"] == 0 and d["programs"] == 1
        assert d["pts"] == [transport.FIRST_PTS + transport.TICKS * i for i in range(max(1, -(-n // transport.PES_BYTES)))]
        assert d["random_access"] == list(range(0, len(d["pts"]), transport.RANDOM_EVERY))
    lost = stream[: 188 * 5] + stream[188 * 6 :]
    assert transport.demux(lost)["counter_errors"] == 1
    with pytest.raises(ValueError, match="packet"):
        transport.demux(b"\x00" * 188)


def _table_packets(pid, section, sizes):
    """A table that spans packets, so many bytes of it in each."""
    out, at = [], 0
    for i, n in enumerate(sizes):
        data = (b"\x00" if i == 0 else b"") + section[at : at + n]
        at += n
        stuffing = 183 - len(data) if i < len(sizes) - 1 else None
        if stuffing is None:
            out.append(bytes([0x47, pid >> 8 | (0x40 if i == 0 else 0), pid & 255, 0x10 | i]) + data.ljust(184, b"\xff"))
        else:
            out.append(bytes([0x47, pid >> 8 | (0x40 if i == 0 else 0), pid & 255, 0x30 | i, stuffing]) + (b"\x00".ljust(stuffing, b"\xff") if stuffing else b"") + data)
    return out


def test_transport_reads_legal_streams():
    payload = random.Random(1).randbytes(9000)
    stream = transport.mux(payload)
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    twice = transport.demux(b"".join(p for i, p in enumerate(packets) for _ in range(2 if i % 7 == 3 or i < 3 else 1)))
    assert twice["payload"] == payload and twice["counter_errors"] == 0
    assert transport.demux(b"".join([*packets[:9], packets[8], packets[8], *packets[9:]]))["counter_errors"] == 1
    # a second elementary stream in a map table that spans packets
    other = [p[:1] + bytes([p[1] & 0xE0 | 0x02, 0x05]) + p[3:] for p in packets if (p[1] & 0x1F) << 8 | p[2] == transport.ES_PID]
    pid, private = (0xE000 | transport.ES_PID).to_bytes(2, "big"), bytes([transport.PRIVATE])
    pmt = transport._section(2, 1, pid + b"\xf0\x00" + private + pid + b"\xf0\x00" + private + b"\xe2\x05\xf0\x04ABCD")
    mixed = [packets[0], *_table_packets(transport.PMT_PID, pmt, (7, 11, len(pmt) - 18))]
    mine = [p for p in packets if (p[1] & 0x1F) << 8 | p[2] == transport.ES_PID]
    for a, b in zip(mine, other):
        mixed += [a, b, b"\x47\x1f\xff\x10".ljust(188, b"\xff")]
    both = transport.demux(b"".join(mixed))
    assert both["streams"] == {transport.ES_PID: payload, 0x205: payload} and both["counter_errors"] == both["crc_errors"] == 0
    broken = bytearray(b"".join(packets))
    broken[188 + 12] ^= 1
    assert transport.demux(bytes(broken))["crc_errors"] == 1


def _read_independently(stream):
    """Payload of the one elementary stream: adaptation fields off, parts cut at their starts, headers off."""
    pes = []
    for at in range(0, len(stream), 188):
        p = stream[at : at + 188]
        if int.from_bytes(p[1:3], "big") & 0x1FFF != 0x100:
            continue
        body = p[5 + p[4] :] if p[3] & 0x20 else p[4:]
        if p[1] & 0x40:
            pes.append(b"")
        pes[-1] += body
    return b"".join(x[9 + x[8] :] for x in pes)


def test_transport_query_as_brute_force(spark, odd):
    clash = odd.withColumn("media", F.lit(1)).withColumn("n_bytes", F.lit("x"))
    media = {r.doc_id: bytes(r.media) for r in transport.store(clash).collect()}
    got = {r.doc_id: r for r in transport.features(transport.store(clash)).collect()}
    for r in odd.collect():
        text = (r.text or "").encode()
        want = text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))
        g, m = got[r.doc_id], media[r.doc_id]
        assert _read_independently(m) == want
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(text), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert (g.media_bytes, g.media_sha256) == (len(m), hashlib.sha256(m).hexdigest()) and "counter_errors=0;crc_errors=0" in g.feature
    assert transport.features(transport.store(odd.limit(0))).count() == 0


def test_transport_odd_rows(spark, odd):
    rows = {r.doc_id: r for r in transport.features(transport.store(odd)).collect()}
    assert rows[0].payload_bytes == 64 and rows[0].payload_sha256 == hashlib.sha256(bytes(64)).hexdigest() and rows[6].media_sha256 == rows[7].media_sha256


def test_langid_held_out_accuracy(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs, langid.train(docs), keep=("doc_id", "lang")).where(langid.held_out(F.col("doc_id")))
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    rows = {r.doc_id: r for r in langid.identify(odd, langid.train(odd)).collect()}
    assert rows[0].lang_pred == rows[1].lang_pred == rows[2].lang_pred == "und" and rows[5].lang_pred == "en"
    assert langid.identify(odd, langid.train(odd.limit(0))).where("lang_pred <> 'und'").count() == 0


def _pipeline_by_hand(spark, docs):
    """run()'s rows by other ways: languages row by row, all pairs of texts, SQL for personal data and sources, the library's tokens."""
    from tests.llm.test_near_copies import _brute

    model = langid.train(docs)
    rows = [r.asDict() for r in docs.select(*corpus_pipeline.COLUMNS).collect()]
    for r in rows:
        r["lang"], r["score"] = langid.predict(model, langid.vector(r["text"]))
    rows = [r for r in rows if r["lang"] != "und" and r["score"] >= corpus_pipeline.MIN_SCORE]
    texts = sorted({r["text"] for r in rows})
    group = dict(zip(texts, _brute(texts)))
    first = {}
    for r in rows:
        rank = (r["doc_id"] is None, r["doc_id"] or 0, str(r["lang"]), str(r["source"]), r["n_chars"] or 0)
        key = group[r["text"]]
        if key not in first or rank < first[key][0]:
            first[key] = (rank, r)
    rows = [r for _, r in first.values()]
    c = duckdb.connect()

    def held(rows):
        c.execute("CREATE OR REPLACE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
        c.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r["doc_id"], r["text"], r["source"]) for r in rows])

    held(rows)
    for r, (spans,) in zip(sorted(rows, key=lambda r: r["doc_id"]), c.execute(f"SELECT spans FROM ({pii.ORACLE}) ORDER BY doc_id").fetchall(), strict=True):
        out, at = "", 0
        for kind, a, z in (s.split(":") for s in spans.split(",") if s):
            if int(a) >= at:
                out += r["text"][at : int(a)] + f"<{kind.upper()}>"
            at = max(at, int(z))
        r["text"] = out + r["text"][at:]
    held(rows)
    taken = dict(c.execute(f"SELECT doc_id, taken FROM ({mixing.ORACLE})").fetchall())
    import tokenizers

    library, want = tokenizers.Tokenizer.from_file(bpe.default_vocabulary()), []
    for r in rows:
        pieces = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", r["text"])
        whole, part = divmod(taken[r["doc_id"]], len(pieces)) if pieces else (0, 0)
        for t in [r["text"]] * whole + (["".join(pieces[:part])] if part else []):
            ids = library.encode(t, add_special_tokens=False).ids
            want.append((r["doc_id"], len(ids), tuple(ids)))
    return sorted(want)


def test_pipeline_as_by_hand(spark):
    pytest.importorskip("tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids"]
    assert sorted((r.doc_id, r.n_tokens, tuple(r.ids)) for r in got.collect()) == _pipeline_by_hand(spark, docs)


def test_pipeline_equal_hashes_are_not_equal_texts(spark, monkeypatch):
    rows = [(i, f"{w} stands alone among all of these lines and says {w} twice over", "en", "s", 1) for i, w in enumerate(["alpha", "beta", "gamma", "alpha", "delta", "beta"])]
    docs = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(corpus_pipeline, "text_key", lambda text: F.lit(5).cast("long"))
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == [0, 1, 2, 4]


def test_pipeline_odd_rows(spark, odd, tmp_path):
    kept = odd.withColumn("lang_pred", F.lit("x")).withColumn("node", F.lit(1)).withColumn("taken", F.lit(2))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept.count(), stage(spark, kept, SF)
        assert kept.columns == list(corpus_pipeline.COLUMNS), name
        if name == "near_duplicates":
            assert kept.where("text LIKE 'same text%'").count() == 1
        if name == "personal_data":
            assert kept.count() == before
    odd.limit(0).select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_sample_takes_a_repeated_id_once(spark, monkeypatch):
    kept = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2)
    docs = spark.createDataFrame([(kept, f"the {i} words of a text", "en") for i in range(300)], "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(langid, "fit", lambda x, langs, spark: seen.append((len(x), langs)))
    langid.train(docs)
    assert seen == [(1, ["en"])]


def test_language_votes_and_ties():
    assert langid.decide(["a", "b", "c"], {("a", "b"): 1.0, ("a", "c"): 0.5, ("b", "c"): -2.0}) == ("a", 0.5)
    # one vote each: a beats b by 3, b beats c by 1, c beats a by 1
    assert langid.decide(["a", "b", "c"], {("a", "b"): 3.0, ("a", "c"): -1.0, ("b", "c"): 1.0}) == ("a", -1.0)
    assert langid.decide(["a", "b"], {("a", "b"): 0.0}) == ("a", 0.0) and langid.decide(["a"], {}) == ("a", float("inf"))
    assert langid.decide(["a", "b", "c"], {("a", "b"): 1.0, ("b", "c"): 1.0, ("a", "c"): -1.0})[0] == "a"  # equal sums too: the name


def test_machine_separates():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(1, 0.2, (50, 6)), rng.normal(-1, 0.2, (20, 6))]).astype(np.float32)
    y = np.repeat([1, -1], (50, 20))
    w = langid.train_svm(x, y)
    assert (np.sign(x @ w[:-1] + w[-1]) == y).all() and (y * (x @ w[:-1] + w[-1])).min() > 0.5


def test_more_than_a_hundred_languages_and_one(spark):
    rng = random.Random(8)
    words = {f"x{i:03}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(8)] for i in range(105)}
    rows = [(i, " ".join(rng.choices(words[lang], k=30)), lang) for i, lang in enumerate(sorted(words) * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    found = langid.identify(docs, langid.train(docs), keep=("lang",)).where(langid.held_out(F.col("doc_id"))).collect()
    assert len({r.lang_pred for r in found}) > 100 and sum(r.lang == r.lang_pred for r in found) > 0.95 * len(found)
    one = docs.where("lang = 'x001'")
    assert {(r.lang_pred, r.score) for r in langid.identify(one, langid.train(one)).collect()} == {("x001", 1.0)}
    assert langid.identify(docs.limit(0), langid.train(docs.limit(0))).count() == 0
