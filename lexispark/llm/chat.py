"""Token-level assembly of conversations for training.

The segments of a turn, its role and its content, are encoded separately as ordinary text, so that no content can become
a control token; the reserved ids around them are spliced in afterwards. Control strings that stand in a content are
escaped besides, so that they don't come alive if the decoded text is encoded again elsewhere. The loss mask is the
prefix sum of +1 where a trained segment begins and -1 behind its end.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import table

#: Byte-level BPE ranks; a parameter, the file isn't part of this repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary splits text before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Strings of the control tokens; their ids follow the vocabulary's in this order, behind the one that it leaves free.
CONTROLS = ("<|im_start|>", "<|im_end|>")
FIRST_CONTROL = 50257
#: Strings that are escaped in contents.
ESCAPED = re.compile("<(​*)\\|(im_start|im_end|endoftext)\\|>")
UNESCAPED = re.compile("<​(​*)\\|(im_start|im_end|endoftext)\\|>")
#: Roles whose contents are trained on.
TRAINED = ("assistant",)
#: The role of a turn without one.
NO_ROLE = "unknown"
_ENCODERS: dict[int, tiktoken.Encoding] = {}


def escape(text: str) -> str:
    """Control strings with a zero-width blank behind the first sign; those that have some get one more."""
    return ESCAPED.sub("<​\\1|\\2|>", text)


def unescape(text: str) -> str:
    return UNESCAPED.sub("<\\1|\\2|>", text)


def encoder(ranks: bytes) -> tiktoken.Encoding:
    """The encoding of a rank file, made once in a process."""
    key = hash(ranks)
    if key not in _ENCODERS:
        pairs = (line.split() for line in ranks.splitlines() if line)
        _ENCODERS[key] = tiktoken.Encoding("bpe", pat_str=SPLIT, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    return _ENCODERS[key]


def assemble(turns: list[tuple[str | None, str | None]], encode, trained: tuple[str, ...] = TRAINED) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of the (role, text) turns of a conversation."""
    start, end = FIRST_CONTROL, FIRST_CONTROL + 1
    line = encode("\n")
    parts: list[list[int]] = []
    size, edges = 0, []
    for role, text in turns:
        role = escape(NO_ROLE if role is None else role)
        head, body = [start, *encode(role + "\n")], [*encode(escape(text or "")), end]
        if role in trained:
            edges.append((size + len(head), size + len(head) + len(body)))
        parts += [head, body, line]
        size += len(head) + len(body) + len(line)
    delta = np.zeros(size + 1, np.int8)
    for a, b in edges:
        delta[a] += 1
        delta[b] -= 1
    return np.fromiter((x for p in parts for x in p), np.int32, size), np.cumsum(delta[:-1]).astype(np.int8)


def format_conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", vocabulary: str = VOCABULARY, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """One row for each conversation: (conv_id, n_turns, n_tokens, n_trained, input_ids, loss_mask).

    Turns are ordered by number, then role and text, those without a number last; repeated rows are turns each. A null
    text is an empty content, a null role is ``unknown``; an unknown role is formatted like any other and not trained.
    Rows whose conversation is null belong to none and give nothing. Other columns aren't read.
    """
    with open(vocabulary, "rb") as file:
        shared = turns.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary, whatever the data's size
    turn = F.struct(F.col(turn_col).isNull().alias("none"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    whole = turns.where(F.col(conv_col).isNotNull()).groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    id_type = turns.schema[conv_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(shared.value)
        short: dict[str, list[int]] = {}

        def encode(text: str) -> list[int]:
            if len(text) > 16:
                return encoding.encode_ordinary(text)
            found = short.get(text)
            if found is None:
                if len(short) > 100_000:
                    short.clear()
                found = short[text] = encoding.encode_ordinary(text)
            return found

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                turns_ = part.column(1).to_pylist()
                made = [assemble([(t["role"], t["text"]) for t in c], encode, trained) for c in turns_]
                sizes = np.array([len(ids) for ids, _ in made], np.int64)
                offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([m[k] for m in made]))) for k in (0, 1)]
                numbers = [np.array([len(c) for c in turns_], np.int32), sizes.astype(np.int32), np.array([int(m.sum()) for _, m in made], np.int32)]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, numbers), *lists], names=["conv_id", "n_turns", "n_tokens", "n_trained", "input_ids", "loss_mask"])

    return whole.mapInArrow(run, f"conv_id {id_type}, n_turns int, n_tokens int, n_trained int, input_ids array<int>, loss_mask array<tinyint>")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` as ids and loss masks; a null text is an empty content, a null role is ``unknown``."""
    return format_conversations(table(spark, sf_dir, "conversations"))
