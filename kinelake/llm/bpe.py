"""Byte-pair encoding without a merge loop: the unique last token of every prefix, by dynamic programming.

In the encoding of a string the tokens of each prefix that ends at a token's end are the encoding of that prefix. So one
pass suffices: an automaton names all tokens that end at a position, and the one is right that stays apart from the last
token of the prefix before it. Whether two tokens stay apart follows from their edges alone: replayed backwards from the
two whole tokens, no pair that meets at the border may have a merge that comes before the merges that made either edge.

The automaton's states are the prefixes of tokens, joined by suffix links: a suffix automaton of the text would find the
same matches (all tokens that are suffixes of what was read), but would have to be built for every piece; this one is
built once, over the vocabulary, and its size is bounded by it.

Texts are cut at single spaces between words; where white space is irregular only that stretch is cut by the
pre-tokenizer as a whole. New pieces are encoded in sorted order, so that the last tokens stored for a prefix serve all
pieces that begin with it. The encodings of pieces and words are kept (CACHE of those used lately, as many from before).

Defined results: a null text is empty and has no tokens; special tokens in a text are encoded as such (``specials=False``
makes them ordinary text); rows keep their multiplicity; only the id and text columns are read, so others can't clash; ids
are cast to long (an id that is no number fails under ANSI mode and is null without it); an empty table gives an empty
result. A text may be of any length: its words are encoded CHUNK characters at a time.
"""

from __future__ import annotations

import json
from array import array
from collections import deque
from collections.abc import Iterator

import hashlib
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.runtime import ship, tidy

PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose new words are encoded together.
CHUNK = 1 << 19
#: Pieces, and words, whose encodings one worker keeps as used lately; as many may be kept from before.
CACHE = 70_000
#: Results of pair tests and steps of the automaton that one worker keeps.
PAIRS, STEPS = 300_000, 200_000
#: Where digests alone leave a task it has room for more, and the next one goes on with it.
DIGEST_ROOM = 4
NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in the vocabulary file: printable Latin-1 characters stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_tables(path: str) -> dict:
    """What workers need of a byte-level BPE file: plain lists and dictionaries, bounded by the vocabulary."""
    with open(path, "rb") as f:
        held = f.read()
    spec = json.loads(held)
    alphabet = byte_alphabet()
    to_bytes = lambda s: bytes(alphabet[c] for c in s)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = spec["model"]["vocab"]
    size = max([*vocab.values(), *special.values()]) + 1
    token = [b""] * size
    for s, i in vocab.items():
        if s not in special:
            token[i] = to_bytes(s)
    for s, i in special.items():
        token[i] = s.encode()
    rank, left, right, pair = [-1] * size, [0] * size, [0] * size, {}
    for r, m in enumerate(spec["model"]["merges"]):
        a, b = m if isinstance(m, list) else m.split(" ")
        made, ia, ib = vocab[a + b], vocab[a], vocab[b]
        pair[ia * size + ib] = r
        if rank[made] < 0:
            rank[made], left[made], right[made] = r, ia, ib
    go, at, depth = {}, [-1], [0]
    for i, t in enumerate(token):
        if i in special.values() or not t or (rank[i] < 0 and len(t) > 1):
            continue
        node = 0
        for byte in t:
            key = node << 8 | byte
            if key not in go:
                go[key] = len(at)
                at.append(-1)
                depth.append(depth[node] + 1)
            node = go[key]
        at[node] = i
    return {"digest": hashlib.sha256(held).hexdigest(), "size": size, "token": token, "rank": rank, "left": left, "right": right, "pair": pair, "special": special, "go": go, "at": at, "links": _suffix_links(go, len(at))}


def _suffix_links(go: dict[int, int], n: int) -> list[int]:
    """The node of each node's longest proper suffix that is a node."""
    below: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for key, child in go.items():
        below[key >> 8].append((key & 255, child))
    link, queue = [0] * n, deque(child for _, child in below[0])
    while queue:
        node = queue.popleft()
        for byte, child in below[node]:
            f = link[node]
            while f and (f << 8 | byte) not in go:
                f = link[f]
            link[child] = go.get(f << 8 | byte, 0)
            queue.append(child)
    return link


class Encoder:
    def __init__(self, tables: dict, specials: bool = True, room: int = 1):
        """room: so many times CACHE, PAIRS and STEPS are kept."""
        self.t, self.room = tables, room
        self.find = regex.compile(PRETOKENS).findall
        self.border = regex.compile(r"(?<=\S) (?=\S)").search
        self.special = tables["special"] if specials else {}
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self.whole: dict[int, bool] = {}
        self.apart: dict[int, bool] = {}
        self.steps: dict[int, int] = {}
        self.ending: list[tuple[tuple[int, int], ...] | None] = [None] * len(tables["at"])
        # of pieces and of words the encodings used lately, and those used before
        self.pieces: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes | None] = {}
        self.old_words: dict[str, bytes | None] = {}

    def stay_apart(self, x: int, y: int, once: bool = False) -> bool:
        """Whether tokens x, y side by side are what their joined bytes are encoded as. once: don't count the merge of x and y as wholes."""
        rank, left, right, pair, size = (self.t[k] for k in ("rank", "left", "right", "pair", "size"))
        until_x = until_y = NEVER
        while True:
            merged = None if once else pair.get(x * size + y)
            once = False
            if merged is not None and merged < until_x and merged <= until_y:  # of equal merges the left one comes first
                return False
            if rank[x] > rank[y]:
                until_x, x = rank[x], right[x]
            elif rank[y] >= 0:
                until_y, y = rank[y], left[y]
            else:
                return True

    def is_whole(self, token: int) -> bool:
        """Whether the token's bytes alone are encoded as it."""
        found = self.whole.get(token)
        if found is None:
            a, b = self.t["left"][token], self.t["right"][token]
            found = self.whole[token] = self.t["rank"][token] < 0 or (self.is_whole(a) and self.is_whole(b) and self.stay_apart(a, b, once=True))
        return found

    def _tokens_at(self, node: int) -> tuple[tuple[int, int], ...]:
        """(token, length) of all tokens that are suffixes of the node's string, the longest first."""
        out, at, n = [], self.t["at"], node
        while n:
            if at[n] >= 0:
                out.append((at[n], len(self.t["token"][at[n]])))
            n = self.t["links"][n]
        found = self.ending[node] = tuple(out)
        return found

    def _step(self, key: int) -> int:
        """The node of the longest suffix of a node's string and a byte (key: node << 8 | byte) that is a node."""
        go, links = self.t["go"], self.t["links"]
        node, byte = key >> 8, key & 255
        while node and (node << 8 | byte) not in go:
            node = links[node]
        if len(self.steps) > STEPS * self.room:
            self.steps.clear()
        found = self.steps[key] = go.get(node << 8 | byte, 0)
        return found

    def encode_sorted(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """Ids of each of the pre-tokens, which come in order: what is stored of a prefix holds for the next one that begins with it."""
        size, apart, steps, ending = self.t["size"], self.apart, self.steps, self.ending
        last, back, nodes, before = [-1], [0], [0], b""
        for data in pieces:
            end = 0
            for x, y in zip(before, data):
                if x != y:
                    break
                end += 1
            before = data
            del last[end + 1 :], back[end + 1 :], nodes[end + 1 :]
            node = nodes[end]
            for byte in data[end:] if end else data:
                end += 1
                key = node << 8 | byte
                node = steps.get(key)
                if node is None:
                    node = self._step(key)
                for token, n in ending[node] or self._tokens_at(node):
                    start = end - n
                    if start:
                        key = last[start] * size + token
                        fits = apart.get(key)
                        if fits is None:
                            if len(apart) > PAIRS * self.room:
                                apart.clear()
                            fits = apart[key] = self.stay_apart(last[start], token)
                    else:
                        fits = self.is_whole(token)
                    if fits:
                        last.append(token)
                        back.append(start)
                        nodes.append(node)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            ids = []
            while end:
                ids.append(last[end])
                end = back[end]
            ids.reverse()
            yield ids

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        return next(self.encode_sorted([data]))

    def _learn(self, pieces: set[str]) -> None:
        """Encodings of all pieces into the lately used ones."""
        have, old, new = self.pieces, self.old_pieces, []
        for p in pieces:
            if p not in have:
                found = old.get(p)
                if found is None:
                    new.append((p.encode(), p))
                else:
                    have[p] = found
        new.sort()
        for (_, p), ids in zip(new, self.encode_sorted([b for b, _ in new])):
            have[p] = array("i", ids).tobytes()

    def _segments(self, text: str) -> Iterator[tuple[int | None, bool, str]]:
        """(special token, False, "") or (None, whether a space came before, a stretch of about CHUNK that ends at a border between words)."""
        for part in self.split(text) if self.split and any(s in text for s in self.special) else (text,):
            if part in self.special:
                yield self.special[part], False, ""
                continue
            start, spaced = 0, False
            while len(part) - start > CHUNK and (hit := self.border(part, start + CHUNK)):
                yield None, spaced, part[start : hit.start()]
                start, spaced = hit.end(), True
            if start < len(part):
                yield None, spaced, part[start:]

    def _units(self, spaced: bool, words: list[str]) -> list[tuple[str | None, str]]:
        """Of a stretch with irregular white space: (word, "") where a word stands between single spaces, else (None, the whole irregular part)."""
        out, held = [], [words[0]]
        for w in words[1:]:
            p = held[-1]
            if p and w and not p[-1].isspace() and not w[0].isspace():
                out.append(held)
                held = []
            held.append(w)
        out.append(held)
        single = lambda h: len(h) == 1 and h[0] and not h[0][0].isspace() and not h[0][-1].isspace()
        first = (out[0][0], "") if spaced and single(out[0]) else (None, " " * spaced + " ".join(out[0]))
        return [first, *[(h[0], "") if single(h) else (None, " " + " ".join(h)) for h in out[1:]]]

    def _encode_held(self, held: list[tuple[int, int | None, bool, str]], parts: list[list[bytes]]) -> None:
        split = [(i, special, spaced, text.split(" ")) for i, special, spaced, text in held]
        need: set[str] = set()
        for _, _, spaced, ws in split:
            need.update(ws if spaced else ws[1:])
        words, old, cuts, pieces = self.words, self.old_words, {}, set()
        for w in need:
            if w in words:
                continue
            if w in old:
                words[w] = old[w]
            elif not w or w[0].isspace() or w[-1].isspace():
                words[w] = None
            else:
                cuts[w] = self.find(" " + w)
                pieces.update(cuts[w])
        odd = {w for w in need if w not in cuts and words[w] is None}
        plain, units = {}, {}
        for at, (_, special, spaced, ws) in enumerate(split):
            if special is not None:
                continue
            if not odd.isdisjoint(ws if spaced else ws[1:]) or (len(ws) > 1 and not spaced and ws[0] and ws[0][-1].isspace()):
                units[at] = self._units(spaced, ws)
                plain.update((u, self.find(u)) for w, u in units[at] if w is None)
            elif not spaced:
                plain[ws[0]] = self.find(ws[0])
        for cut in plain.values():
            pieces.update(cut)
        self._learn(pieces)
        known = self.pieces
        for w, cut in cuts.items():
            words[w] = known[cut[0]] if len(cut) == 1 else b"".join([known[p] for p in cut])
        whole = {u: b"".join([known[p] for p in cut]) for u, cut in plain.items()}
        for at, (i, special, spaced, ws) in enumerate(split):
            if special is not None:
                parts[i].append(array("i", [special]).tobytes())
            elif at in units:
                parts[i] += [whole[u] if w is None else words[w] for w, u in units[at]]
            else:
                if not spaced:
                    parts[i].append(whole[ws[0]])
                    del ws[0]
                parts[i].append(b"".join(map(words.__getitem__, ws)))
        if len(self.words) > CACHE * self.room:
            self.words, self.old_words = {}, self.words
        if len(self.pieces) > CACHE * self.room:
            self.pieces, self.old_pieces = {}, self.pieces

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text. New words of about CHUNK characters are encoded together."""
        parts: list[list[bytes]] = [[] for _ in texts]
        held, size = [], 0
        for i, text in enumerate(texts):
            for special, spaced, stretch in self._segments(text):
                held.append((i, special, spaced, stretch))
                size += len(stretch) + 1
                if size > CHUNK:
                    self._encode_held(held, parts)
                    held, size = [], 0
        self._encode_held(held, parts)
        return [np.frombuffer(b"".join(p), np.int32) for p in parts]

    def forget(self) -> None:
        """Drop what was kept: a worker that goes on to other work holds only the tables."""
        for kept in (self.pieces, self.old_pieces, self.words, self.old_words, self.apart, self.steps):
            kept.clear()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        return self.encode_all([text])[0]


def decode(ids: list[int], token: list[bytes]) -> str:
    return b"".join([token[i] for i in ids]).decode("utf-8", "replace")


_encoders: dict[tuple, Encoder] = {}


def _encoder(shared, specials: bool, room: int = 1) -> Encoder:
    """One encoder per worker process and vocabulary, told by the digest of its whole file."""
    key = (shared.value["digest"], specials, room)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(shared.value, specials, room)
    return _encoders[key]


def encode_texts(docs: DataFrame, tables: dict, id_col: str = "doc_id", text_col: str = "text", specials: bool = True) -> DataFrame:
    """(id, ids array<int>) of every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, specials)
        for b in batches:
            ids = encoder.encode_all([t or "" for t in b.column(1).to_pylist()])
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=[id_col, "ids"])
        encoder.forget()

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(tidy(run), f"`{id_col}` long, ids array<int>")


def encode_digests(docs: DataFrame, tables: dict, id_col: str = "doc_id", text_col: str = "text", specials: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row: the ids of encode_texts and the text that they decode to, digested where they are made."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, token = _encoder(shared, specials, DIGEST_ROOM), shared.value["token"]
        name = [str(i) for i in range(len(token))]
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for x in encoder.encode_all([t or "" for t in b.column(1).to_pylist()]):
                ids = x.tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join([name[i] for i in ids]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(decode(ids, token).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kept = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    return kept.mapInArrow(tidy(run), f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    tables = load_tables(vocabulary or default_vocabulary())
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), tables)
