"""Chat formatting as a prefix tree: turns that conversations share are emitted once.

Conversations are sorted by the digests of their turns, so those with equal first turns
are neighbours, in depth-first order of the tree. Each sorted part becomes token shards
of its own: a node for each turn that the conversation before doesn't share, with its
tokens, their position ids (counted along the path from the root, not along the shard),
the loss mask, and the intervals of the shard that its ancestors take, to which its
tokens attend beside themselves.

Equal conversations are one path, found by pre-aggregation, so a conversation or a first
turn that a third of all rows share makes no large group: where a part or a shard ends
inside a tree, the path to the cut begins the next shard anew.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. The two control marks are ids of their
own beyond the vocabulary; ``<|`` in a text or role becomes ``<\\|``, one more backslash
for each that stands there, and a line end in a role ``\\n``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.llm.common import column_or_null, written
from lexivane.llm.tokens import Encoder, spelled

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
#: Tokens after which a shard is closed at the next conversation.
SHARD_TOKENS = 4_000_000
NODES = (
    "shard long, node long, parent long, start long, position_ids array<int>, tokens array<int>, loss_mask array<boolean>, "
    "attends array<struct<start:long,end:long>>, conversation string"
)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of every id of a byte-level vocabulary, flat, where each id's begin, and how many they are.

    The two ids beyond the vocabulary, the control marks, have none.
    """
    encoder = Encoder.of(path)
    if not encoder.by_words:
        raise ValueError("only a plain byte-level tokenizer spells texts byte by byte")
    letters = {c: b for b, c in enumerate(spelled(bytes(range(256))))}
    special = {x.content for x in encoder.model.get_added_tokens_decoder().values()}
    out = [b""] * (len(encoder.length) + 2)
    for token, i in encoder.model.get_vocab(with_added_tokens=True).items():
        out[i] = token.encode() if token in special else bytes(letters[c] for c in token)
    lengths = np.array([len(x) for x in out], dtype=np.int64)
    return np.frombuffer(b"".join(out), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths


class _Shard:
    """The open shard of a task: its number, its tokens, the path to the last node."""

    def __init__(self, number: int):
        self.number, self.size, self.nodes, self.path = number, 0, 0, []

    def add(self, turn: tuple[str, str], tokens: np.ndarray, mask: np.ndarray) -> list:
        above = self.path[-1] if self.path else None
        attends = _follow(above["attends"], above["start"], above["end"]) if above else []
        at = above["position"] if above else 0
        node = {"turn": turn, "tokens": tokens, "mask": mask, "node": self.nodes, "start": self.size, "end": self.size + len(tokens), "position": at + len(tokens), "attends": attends}
        row = [self.number, node["node"], above["node"] if above else None, self.size, at, tokens, mask, attends, None]
        self.path.append(node)
        self.size, self.nodes = node["end"], self.nodes + 1
        return row


def _follow(intervals: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """The intervals with one more behind them; what touches is one."""
    if intervals and intervals[-1][1] == start:
        return [*intervals[:-1], (intervals[-1][0], end)]
    return [*intervals, (start, end)]


def _lists(values: pa.Array, lengths: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), values)


def _batch(rows: list[list]) -> pa.RecordBatch:
    sizes = [len(r[5]) for r in rows]
    tokens = np.concatenate([r[5] for r in rows])
    ends = np.cumsum(sizes)
    positions = np.arange(len(tokens)) - np.repeat(ends - sizes - [r[4] for r in rows], sizes)
    intervals = [x for r in rows for x in r[7]]
    span = pa.StructArray.from_arrays([pa.array([x[0] for x in intervals], pa.int64()), pa.array([x[1] for x in intervals], pa.int64())], ["start", "end"])
    columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
    columns += [_lists(pa.array(positions, pa.int32()), sizes), _lists(pa.array(tokens, pa.int32()), sizes), _lists(pa.array(np.concatenate([r[6] for r in rows])), sizes)]
    columns += [_lists(span, [len(r[7]) for r in rows]), pa.array([r[8] for r in rows], pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["shard", "node", "parent", "start", "position_ids", "tokens", "loss_mask", "attends", "conversation"])


def _build(tokenizer: str, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = Encoder.of(tokenizer)
        controls, line_end = len(encoder.length), encoder.plain("\n")
        ids = lambda raw: np.frombuffer(raw, dtype=encoder.kind).astype(np.int32)
        tail = np.concatenate([[controls + 1], ids(line_end)]).astype(np.int32)
        heads: dict[str, np.ndarray] = {}
        shard = _Shard(TaskContext.get().partitionId() << 24)

        def head_of(role: str) -> np.ndarray:
            if len(heads) > 10_000:
                heads.clear()
            if role not in heads:
                heads[role] = np.concatenate([[controls], ids(encoder.plain(escape_role(role) + "\n"))]).astype(np.int32)
            return heads[role]

        for batch in batches:
            turns = batch.column(1)
            flat = turns.flatten()
            pairs = list(zip(flat.field(0).to_pylist(), flat.field(1).to_pylist(), strict=True))
            ends = np.cumsum([0, *turns.value_lengths().to_pylist()]).tolist()
            talks = [pairs[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            last, new = [p["turn"] for p in shard.path], []
            for talk in talks:
                same = 0
                while same < min(len(talk), len(last)) and talk[same] == last[same]:
                    same += 1
                new.append(same)
                last = talk
            fresh = [t for talk, same in zip(talks, new, strict=True) for t in talk[same:]]
            bodies = encoder.encode([escape(x) for _, x in fresh])
            parts = [x for (role, _), body in zip(fresh, bodies, strict=True) for x in (head_of(role), ids(body), tail)]
            lengths = np.array([len(x) for x in parts], dtype=np.int64).reshape(-1, 3)
            trained = np.zeros(lengths.shape, dtype=bool)
            trained[:, 1] = [role == TRAINED_ROLE for role, _ in fresh]
            tokens = np.concatenate(parts) if parts else tail[:0]
            mask = np.repeat(trained.ravel(), lengths.ravel())
            stops = np.cumsum(lengths.sum(axis=1)).tolist()
            at, first, rows = 0, 0, []
            for key, talk, same in zip(batch.column(0).to_pylist(), talks, new, strict=True):
                if shard.size >= shard_tokens:
                    kept = shard.path[:same]
                    shard = _Shard(shard.number + 1)
                    rows += [shard.add(p["turn"], p["tokens"], p["mask"]) for p in kept]
                del shard.path[same:]
                for turn in talk[same:]:
                    rows.append(shard.add(turn, tokens[first : stops[at]], mask[first : stops[at]]))
                    first, at = stops[at], at + 1
                # Sorted, a conversation stands before those that go on from it: its last node is new.
                if rows:
                    rows[-1][8] = rows[-1][8] or key
                if len(rows) >= 2_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)
            for p in shard.path:  # views would keep the whole batch
                p["tokens"], p["mask"] = p["tokens"].copy(), p["mask"].copy()

    return run


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, key, path) of (conv_id, turn, role, text) rows.

    Turns are ordered by (turn, role, text), null first; null roles and texts are empty;
    rows without a conv_id are one conversation; repeated rows are repeated turns.
    """
    empty = lambda c: F.coalesce(column_or_null(turns, c, "string"), F.lit("")).alias(c)
    rows = turns.select(column_or_null(turns, "conv_id", "long").alias("conv_id"), F.struct(column_or_null(turns, "turn", "long").alias("turn"), empty("role"), empty("text")).alias("t"))
    talks = rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    line = lambda t: F.concat(F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"])
    digests = F.transform("turns", lambda t: F.sha2(line(t), 256))
    return talks.select("conv_id", "turns", F.sha2(F.array_join(digests, ""), 256).alias("key"), F.array_join(F.transform(digests, lambda d: F.substring(d, 1, 16)), "").alias("path"))


def prefix_tree(talks: DataFrame, tokenizer: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The nodes of the prefix tree over all different conversations, in shards."""
    different = talks.groupBy("key").agg(F.first("turns").alias("turns"), F.first("path").alias("path"))
    sorted_ = different.repartitionByRange("path", "key").sortWithinPartitions("path", "key").select("key", "turns")
    return written(sorted_.mapInArrow(_build(tokenizer, shard_tokens), NODES), "chat-tree")


def _ends(column: pa.ListArray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def _spelled_rows(batch: pa.RecordBatch, table) -> Iterator[tuple[bytes, bytes]]:
    """Of each node the bytes of all its tokens but the marks, and of those under the loss mask; positions are checked."""
    flat, start, length = table
    tokens, at = batch.column(5).flatten().to_numpy(), _ends(batch.column(5))
    spans, span_at = batch.column(7).flatten(), _ends(batch.column(7))
    width = np.concatenate([[0], np.cumsum(spans.field(1).to_numpy() - spans.field(0).to_numpy())])
    seen = np.diff(width[span_at])
    if (batch.column(4).flatten().to_numpy() != np.arange(len(tokens)) - np.repeat(at[:-1] - seen, np.diff(at))).any():
        raise ValueError("positions don't follow the attended intervals")
    marks = len(length) - 2
    closing = np.flatnonzero(tokens == marks + 1)
    if (tokens[at[:-1]] != marks).any() or (tokens == marks).sum() != len(seen) or len(closing) != len(seen) or (closing <= at[:-1]).any() or (closing >= at[1:]).any():
        raise ValueError("a turn isn't marked")
    own = length[tokens]
    ends = np.concatenate([[0], np.cumsum(own)])
    raw = flat[np.repeat(start[tokens] - ends[:-1], own) + np.arange(ends[-1])]
    mask = batch.column(6).flatten().to_numpy(zero_copy_only=False)
    trained = raw[np.repeat(mask, own)].tobytes()
    trained_ends = np.concatenate([[0], np.cumsum(own * mask)])[at].tolist()
    raw, ends, closing = raw.tobytes(), ends.tolist(), closing.tolist()
    for i, (a, c) in enumerate(zip(at.tolist(), closing, strict=False)):
        if raw[ends[c] : ends[at[i + 1]]] != b"\n":
            raise ValueError("a turn doesn't end its line")
        yield raw[ends[a] : ends[c]], trained[trained_ends[i] : trained_ends[i + 1]]


def _read(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(tokenizer)
        shard, path = None, []
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            out = []
            named = [batch.column(i).to_pylist() for i in (0, 1, 2, 3, 8)]
            spans, span_at = batch.column(7).flatten(), _ends(batch.column(7)).tolist()
            intervals = list(zip(spans.field(0).to_pylist(), spans.field(1).to_pylist(), strict=True))
            sizes = batch.column(5).value_lengths().to_pylist()
            for i, (number, node, parent, start, key, (turn, loss)) in enumerate(zip(*named, _spelled_rows(batch, table), strict=True)):
                if number != shard:
                    shard, path = number, []
                while path and path[-1]["node"] != parent:
                    path.pop()
                above = path[-1] if path else {"turns": hashlib.sha256(), "loss": hashlib.sha256(), "n": 0, "loss_chars": 0, "chars": 0, "seen": []}
                if intervals[span_at[i] : span_at[i + 1]] != above["seen"]:
                    raise ValueError("the attended intervals aren't the ancestors'")
                role, _, text = turn.decode().partition("\n")
                said = unescape(loss.decode())
                turns, losses = above["turns"].copy(), above["loss"].copy()
                turns.update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())
                losses.update(said.encode())
                chars = len(START) + len(role) + 1 + len(text) + len(END) + 1
                here = {"node": node, "seen": _follow(above["seen"], start, start + sizes[i]), "turns": turns, "loss": losses, "n": above["n"] + 1, "loss_chars": above["loss_chars"] + len(said), "chars": above["chars"] + chars}
                path.append(here)
                if key:
                    out.append((key, here["n"], turns.hexdigest(), here["loss_chars"], losses.hexdigest(), here["chars"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return run


def read_tree(nodes: DataFrame, tokenizer: str) -> DataFrame:
    """Per different conversation, read back from the tokens of its path."""
    rows = nodes.repartition("shard").sortWithinPartitions("shard", "start")
    return rows.mapInArrow(_read(tokenizer), "key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_all(turns: DataFrame, tokenizer: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Build the tree of (conv_id, turn, role, text) rows and read every conversation back.

    Conversations are joined to their path by its digest; a hot path is split by AQE. An
    empty table gives no rows.
    """
    talks = conversations_of(turns)
    members = written(talks.select("conv_id", "key"), "chat-members")
    read = written(read_tree(prefix_tree(talks, tokenizer, shard_tokens), tokenizer), "chat-read")
    return members.join(read, "key").drop("key")
