"""Chat formatting at token level.

A turn becomes <|start|> role <|sep|> text <|end|>. Role and text are encoded on their
own, so that nothing in them can become a control token; the control tokens are reserved
ids beyond the vocabulary, spliced in between. The loss mask is the running sum of +1
where an assistant text begins and -1 where it ends. Strings that look like control
strings get an escape character after their first character, also where one is there
already, so that removing one undoes it exactly.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlab.llm.arrow import map_batches, ship

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-tokenisation pattern of the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTROL = ("<|start|>", "<|sep|>", "<|end|>")
ESCAPE = "⁣"
#: What follows the first character of a control string: this template's and other common ones.
REST = rf"(?i:[|｜][^|｜<>\s{ESCAPE}]+[|｜]>|/?s>|</?sys>>|/?(?:inst|sys|available_tools|tool_calls|tool_results)\]|/?(?:bos|eos|pad|unk|mask|cls|sep|think|tool_call|tool_response|start_of_turn|end_of_turn|fim_prefix|fim_middle|fim_suffix)>)"
ESCAPING = re.compile(rf"([<\[])({ESCAPE}*)(?={REST})")
ESCAPED = re.compile(rf"([<\[]){ESCAPE}({ESCAPE}*)(?={REST})")
#: Characters after which a text is cut where the pattern cuts it anyway: before a space
#: between two ASCII letters or digits, so that its ids are those of the whole.
PIECE = 1 << 16
CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def escape(text: str) -> str:
    return ESCAPING.sub(rf"\1{ESCAPE}\2", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2", text)


class Codec:
    """Encoder with three reserved ids after its vocabulary, from the lines of a rank file."""

    def __init__(self, lines: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line.strip())}
        self.bpe = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.start, self.sep, self.end = range(max(ranks.values()) + 1, max(ranks.values()) + 4)

    def encode(self, text: str) -> list[int]:
        text, out, at = escape(text), [], 0
        while at < len(text):
            cut = CUT.search(text, at + PIECE)
            end = cut.start() if cut else len(text)
            out += self.bpe.encode_ordinary(text[at:end])
            at = end
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return self.bpe.decode_bytes(list(ids)).decode("utf-8")

    def turns(self, roles: list[str], texts: list[str], learned: frozenset[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and loss mask of each turn."""
        ids, flips, ends = [], [], []
        for role, text in zip(roles, texts, strict=True):
            head, body = self.encode(role), self.encode(text)
            if role in learned:
                flips += [(len(ids) + len(head) + 2, 1), (len(ids) + len(head) + 2 + len(body), -1)]
            ids += [self.start, *head, self.sep, *body, self.end]
            ends.append(len(ids))
        steps = np.zeros(len(ids) + 1, np.int8)
        for at, step in flips:
            steps[at] += step
        mask = np.cumsum(steps[:-1], dtype=np.int8)
        cuts = ends[:-1]
        return np.split(np.array(ids, np.int32), cuts), np.split(mask, cuts)


@lru_cache(maxsize=2)
def codec(lines: bytes) -> Codec:
    return Codec(lines)


def shipped(spark: SparkSession, path: str) -> Broadcast:
    """The driver's vocabulary file (a few MB) for the executors, which need not have it."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def format_turns(conversations: DataFrame, *, tokenizer: str = TOKENIZER, learned: Iterable[str] = ("assistant",), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conversation, pos, ids, loss_mask, start.

    `pos` counts the conversation's turns from 0 (by turn, null first; ties by role, then
    text), `start` is the number of tokens before the turn: a conversation's sequence is
    its rows' ids in order of pos. Null roles and texts are empty; rows without a
    conversation id form one conversation; repeated rows are repeated turns. Conversations
    are never gathered, so their length is not bounded by a task's memory.
    """
    learned, vocabulary = frozenset(learned), shipped(conversations.sparkSession, tokenizer)
    rows = conversations.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(cols: dict[str, list]) -> dict[str, object]:
        ids, masks = codec(vocabulary.value).turns(cols["role"], cols["text"], learned) if cols["role"] else ([], [])
        digest = [hashlib.sha256(f"{r}\n{t}".encode()).hexdigest()[:16] for r, t in zip(cols["role"], cols["text"], strict=True)]
        return {"conv": cols["conv"], "turn": cols["turn"], "role": cols["role"], "tie": digest, "ids": ids, "loss_mask": masks}

    out = map_batches(rows, run, f"conv {kinds['conv']}, turn {kinds['turn']}, role string, tie string, ids array<int>, loss_mask array<tinyint>", slice_rows=512)
    w = Window.partitionBy("conv").orderBy("turn", "role", "tie").rowsBetween(Window.unboundedPreceding, 0)
    return out.select(
        F.col("conv").alias(id_col), (F.count(F.lit(1)).over(w) - 1).alias("pos"), "ids", "loss_mask", (F.sum(F.size("ids")).over(w) - F.size("ids")).alias("start")
    )


def read_back(turns: DataFrame, *, tokenizer: str = TOKENIZER, id_col: str = "conv_id") -> DataFrame:
    """Digests of what the token sequences say, one row per conversation.

    Rows stream through in order of conversation and pos; a conversation's state is two
    hashes and four counters.
    """
    kind = turns.schema[id_col].dataType.simpleString()
    ordered = turns.select(id_col, "pos", "ids", "loss_mask").repartition(F.col(id_col)).sortWithinPartitions(id_col, "pos")
    ship(turns.sparkSession)
    vocabulary = shipped(turns.sparkSession, tokenizer)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, here, state, schema = codec(vocabulary.value), None, None, None
        fixed = sum(map(len, CONTROL))

        def close() -> pa.RecordBatch:
            n, told, loss, lost, chars = state
            return pa.RecordBatch.from_pydict({id_col: [here], "n_turns": [n], "turns_sha256": [told.hexdigest()], "loss_chars": [lost], "loss_sha256": [loss.hexdigest()], "formatted_chars": [chars]}, schema)

        for batch in batches:
            schema = schema or pa.schema([(id_col, batch.schema.field(0).type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
            keys, idl, ml = batch.column(0).to_pylist(), batch.column(2), batch.column(3)
            done = []
            for i, key in enumerate(keys):
                if state is None or key != here:
                    if state is not None:
                        done.append(close())
                    here, state = key, [0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                ids, mask = idl[i].values.to_numpy(zero_copy_only=False), ml[i].values.to_numpy(zero_copy_only=False)
                sep = int(np.argmax(ids == c.sep))
                if ids[0] != c.start or ids[-1] != c.end or ids[sep] != c.sep:
                    raise ValueError("not a formatted turn")
                role, text = c.decode(ids[1:sep].tolist()), c.decode(ids[sep + 1 : -1].tolist())
                state[4] += fixed + len(role) + len(text)
                state[0] += 1
                state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                under = unescape(c.decode(ids[mask == 1].tolist()))
                state[2].update(under.encode())
                state[3] += len(under)
            yield from done
        if state is not None:
            yield close()

    return ordered.mapInArrow(run, f"`{id_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
