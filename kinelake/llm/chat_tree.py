"""Chat formatting as prefix trees: shared initial turns are emitted once, depth-first.

Every conversation becomes a path of turn nodes. Conversations are dealt out by range of their path, which is the
depth-first order of the whole forest, so a first turn that a third of all conversations share is split like any other.
Each partition cuts its part of the order into packs of bounded size; a pack emits the ancestors of its first leaf again,
so a shared turn is there once per pack that holds conversations with it (a pack has PACK_CHARS of turns, or that many
/ 64 conversations). A conversation is one row and must fit a task's memory.
The token unit is one code point of the formatted text, which every tokenizer's tokens are made of.

A pack has: ``text`` (all nodes, depth-first), per node its ``start`` and ``end`` in the text, its ``parent`` (-1: a
root), the position id of its first token (``position``: tokens of all ancestors; ``token_positions`` lists all), the merged text intervals of its
ancestors and itself that its tokens may attend to (``attend``; within the node itself causally), and the interval under
the loss mask (``loss_start``, ``loss_end``: an assistant's text, else empty); and per leaf the conversation's id with the
path of nodes that it reads.

Defined results: a null text or role is empty; rows of a conversation are ordered by turn (null first), then role and
text; repeated rows are repeated turns; a null id is a conversation like any other, other ids are cast to long (one that is
no number fails under ANSI mode and is null without it); an empty table gives no pack; only the four named columns are
read, so extra columns can't clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.runtime import cut, ship

#: A pack is closed at the first leaf after this many code points.
PACK_CHARS = 1 << 18
HEAD, AFTER_ROLE, END = "### ", ": ", " </turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:|\n")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:|\n)")

PACK_SCHEMA = (
    "pack_id string, text string, nodes array<struct<start: long, end: long, parent: int, position: long, attend: array<struct<a: long, b: long>>, "
    "loss_start: long, loss_end: long>>, leaves array<struct<conv_id: long, path: array<int>>>"
)


def escape(text: str) -> str:
    """Control strings, and the backslash itself, get a backslash before them."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The marked turn, and the interval of the escaped text in it."""
    head = HEAD + _ROLE_CONTROL.sub(lambda m: "\\" + m[0], role[:1].upper() + role[1:] if role in ("user", "assistant", "system") else "=" + role) + AFTER_ROLE
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


#: role, then text; a backslash takes the next character (or control string) with it.
_TURN = re.compile(r"### ((?:\\(?:\\|###|</turn>|:|\n)|[^\\:\n])*): ((?:[^\\]|\\(?:\\|###|</turn>))*?) </turn>\n", re.DOTALL)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The inverse of joined format_turn()s; raises ValueError for anything else."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        role = unescape(m[1])
        out.append((role[1:] if role.startswith("=") else role.lower(), unescape(m[2])))
        at = m.end()
    return out


def conversations_of(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns) with turns in order; ``path`` orders conversations depth-first: the hashes of their turns."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    whole = rows.groupBy(F.col(id_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    path = F.array_join(F.transform("turns", lambda t: F.substring(F.md5(F.concat(t.role, F.lit("\n"), t.text)), 1, 12)), "")
    return whole.withColumn("path", path)


def _packs(batches: Iterator[pd.DataFrame], pack_chars: int) -> Iterator[pd.DataFrame]:
    """Packs of conversations that come in depth-first order."""
    texts: list[str] = []
    nodes: list[dict] = []
    leaves: list[dict] = []
    stack: list[tuple[tuple[str, str], int]] = []
    size = 0

    def closed() -> pd.DataFrame:
        text = "".join(texts)
        name = hashlib.md5(f"{leaves[0]['conv_id']}:{len(leaves)}:{text}".encode("utf-8", "surrogatepass")).hexdigest()
        return pd.DataFrame({"pack_id": [name], "text": [text], "nodes": [list(nodes)], "leaves": [list(leaves)]})

    for b in batches:
        for conv_id, turns in zip(b.conv_id, b.turns, strict=True):
            turns = [(t["role"], t["text"]) for t in turns]
            depth = 0
            while depth < min(len(stack), len(turns)) and stack[depth][0] == turns[depth]:
                depth += 1
            del stack[depth:]
            for turn in turns[depth:]:
                marked, a, z = format_turn(*turn)
                parent = stack[-1][1] if stack else -1
                position = nodes[parent]["position"] + nodes[parent]["end"] - nodes[parent]["start"] if stack else 0
                attend = [dict(x) for x in nodes[parent]["attend"]] if stack else []
                if attend and attend[-1]["b"] == size:
                    attend[-1]["b"] = size + len(marked)
                else:
                    attend.append({"a": size, "b": size + len(marked)})
                loss = (size + a, size + z) if turn[0] == "assistant" else (size, size)
                nodes.append({"start": size, "end": size + len(marked), "parent": parent, "position": position, "attend": attend, "loss_start": loss[0], "loss_end": loss[1]})
                stack.append((turn, len(nodes) - 1))
                texts.append(marked)
                size += len(marked)
            leaves.append({"conv_id": None if pd.isna(conv_id) else int(conv_id), "path": [n for _, n in stack]})
            if size >= pack_chars or len(leaves) >= pack_chars // 64:
                yield closed()
                texts, nodes, leaves, stack, size = [], [], [], [], 0
    if leaves:
        yield closed()


def pack_tree(rows: DataFrame, pack_chars: int = PACK_CHARS, partitions: int | None = None, **columns: str) -> DataFrame:
    """One row per pack (PACK_SCHEMA) of all conversations in rows."""
    spark = rows.sparkSession
    ship(spark)
    whole = cut(conversations_of(rows, **columns))  # range bounds are sampled: the grouped rows would be made twice
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = whole.repartitionByRange(n, "path", F.xxhash64("conv_id")).sortWithinPartitions("path", "conv_id")
    return ordered.select(F.col("conv_id").cast("long"), "turns").mapInPandas(lambda batches: _packs(batches, pack_chars), PACK_SCHEMA)


def token_positions(packs: DataFrame) -> DataFrame:
    """(pack_id, positions array<long>): the position id of every token of a pack's text, ancestors counted, siblings not."""
    spans = F.transform("nodes", lambda n: F.when(n["end"] > n["start"], F.sequence(n["position"], n["position"] + n["end"] - n["start"] - 1)).otherwise(F.array().cast("array<bigint>")))
    return packs.select("pack_id", F.flatten(spans).alias("positions"))


def read_conversations(packs: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss) of every leaf, from the packs alone: what its last node may attend to, parsed; loss: the unescaped texts under the mask."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, nodes, leaves in zip(b.text, b.nodes, b.leaves, strict=True):
                for leaf in leaves:
                    path = [nodes[i] for i in leaf["path"]]
                    formatted = "".join(text[x["a"] : x["b"]] for x in (path[-1]["attend"] if path else []))
                    loss = [unescape(text[n["loss_start"] : n["loss_end"]]) for n in path if n["loss_end"] > n["loss_start"]]
                    rows.append((leaf["conv_id"], formatted, [{"role": r, "text": t} for r, t in parse_turns(formatted)], loss))
            out = pd.DataFrame(rows, columns=["conv_id", "formatted", "turns", "loss"])
            out["conv_id"] = out["conv_id"].astype("Int64")
            yield out

    return packs.mapInPandas(run, "conv_id long, formatted string, turns array<struct<role: string, text: string>>, loss array<string>")


#: Conversation -7 of the query: both turns hold control strings.
TRICKY = r"\### Assistant: </turn> ok"


def op2_chat_tree(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, read back from the packs."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], rows.schema)
    back = read_conversations(pack_tree(rows.unionByName(more)))
    digest = lambda parts: F.sha2(F.array_join(parts, "").cast("binary"), 256)
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))).alias("turns_sha256"),
        F.length(F.array_join("loss", "")).cast("long").alias("loss_chars"),
        digest(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Everything but formatted_chars follows from the input alone; that column restates the template.
ORACLE = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (SELECT *, length(role) + (CASE WHEN role IN ('user', 'assistant', 'system') THEN 0 ELSE 1 + length(role) - length(replace(replace(role, ':', ''), '\', '')) END)
         + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) + 15 AS chars FROM n)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
