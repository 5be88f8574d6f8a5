"""The whole query op3 against fingerprints and components computed one by one from its contract."""

import random
import re

import pytest
import xxhash

from kinelake.llm import simhash


def _fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _texts():
    r = random.Random(11)
    words = ["Alpha", "beta", "GAMMA", "É", "straße", " x", "a\u001cb", "δ", "日本", "one", "two", "İ"]
    out = [None, "", " \t\n", "one", "ONE", "a b c", "a b c d", "a  b\tc\nd", "a b c d e", "x x x x x x x x", "É é", " ", "w " * 3000]
    for _ in range(60):
        base = r.choices(words, k=r.randint(4, 200))
        out.append(r.choice([" ", "\n", "\x0b", " \r\n"]).join(base))
        changed = list(base)
        changed[r.randrange(len(base))] = "other"
        out += [" ".join(changed), " ".join([*base, "end"]), " ".join(base).upper().replace("SS", "ß")]
    return out


@pytest.mark.parametrize("split_at", [simhash.SPLIT_AT, 2])
def test_query_as_its_contract(spark, tmp_path, monkeypatch, split_at):
    texts = _texts()
    spark.createDataFrame([(1000 - i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    if split_at != simhash.SPLIT_AT:
        plain = simhash.links
        monkeypatch.setattr(simhash, "links", lambda fps, radius: plain(fps, radius, split_at))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op3_simhash(spark, str(tmp_path)).collect()}
    fps = {1000 - i: _fingerprint(t) for i, t in enumerate(texts)}
    low = {i: i for i in fps}
    moved = True
    while moved:
        moved = False
        for a in fps:
            for b in fps:
                if low[a] < low[b] and (fps[a] ^ fps[b]).bit_count() <= 4:
                    low[b], moved = low[a], True
    assert got == {i: (f"{fp:016x}", low[i]) for i, fp in fps.items()}
    assert any(fps[a] != fps[b] and low[a] == low[b] for a in fps for b in fps) and 1 < len(set(low.values())) < len(texts)
