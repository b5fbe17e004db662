"""Chat formatting by columnar byte assembly.

Every turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside
roles and texts are escaped with a backslash after their first character, and backslashes
are doubled, so that no control string of the output comes from a text and the original can
be read back. Turns are dealt by ranges of (conversation, turn); a long conversation is
spread over several tasks and chunks. A chunk's bytes are gathered at once: segment lengths,
their running sum and one index array for headers, roles, texts and ends.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridemill.llm import spans

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
#: Strings that chat templates and tokenizers use for control.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"
CHUNK = 1 << 20  # bytes of text in a chunk, about
CHUNK_SCHEMA = "conv_id bigint, first_turn bigint, chunk bigint, n_turns bigint, formatted string, turn_ends array<int>, loss_starts array<int>, loss_ends array<int>"


def escape(texts: pa.Array, controls: tuple[str, ...] = CONTROL) -> pa.Array:
    """Texts in which no control string is left; ``unescape`` gives them back."""
    out = pc.replace_substring(texts, "\\", "\\\\")
    for control in controls:
        out = pc.replace_substring(out, control, f"{control[0]}\\{control[1:]}")
    return out


def escape_role(roles: pa.Array) -> pa.Array:
    """Roles without control strings and on one line."""
    return pc.replace_substring(escape(roles), "\n", "\\n")


def unescape(text: str) -> str:
    """The original of an escaped text or role: a backslash and n stand for a line feed, any other pair for its second sign."""
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL) if "\\" in text else text


def assemble(segments: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ``n`` rows of segments, and the end of each segment (rows by segments).

    Each segment column is given as flat bytes with offsets of ``n`` or of one entry; the
    latter stands in every row.
    """
    width = len(segments)
    source = np.concatenate([data for data, _ in segments])
    base = np.cumsum([0] + [len(data) for data, _ in segments])
    begin, size = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)
    for k, (_, offsets) in enumerate(segments):
        begin[:, k], size[:, k] = base[k] + offsets[:-1], np.diff(offsets)
    ends = np.cumsum(size.reshape(-1))
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    np.take(source, spans.places(begin.reshape(-1), size.reshape(-1)), out=out)
    return out, ends.reshape(n, width)


def format_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Chunks of formatted conversations with turn ends and the loss mask, as byte ranges.

    A chunk holds consecutive turns of one conversation; ``first_turn`` and ``chunk`` put a
    conversation's chunks in order. Null roles and texts are empty; rows are ordered by
    turn (nulls first), then role and text, so ties and repeated rows have their place; rows
    without a conversation id form one conversation of their own. Other columns are left
    out; an empty table gives no chunks.
    """
    rows = turns.select(F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.fillna("", ["role", "text"])
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    rows = rows.repartitionByRange(*order[:2], "role", F.xxhash64("text")).sortWithinPartitions(*order)
    rows = rows.withColumn("part", F.spark_partition_id().cast("bigint"))
    fixed = [spans.flat(pa.array([s])) for s in (START, MIDDLE, END)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            for part in spans.slices(batch, "text", CHUNK):
                ids = pc.fill_null(part.column("conv_id"), -(1 << 63)).to_numpy()
                bounds = np.append(np.flatnonzero(np.diff(ids, prepend=ids[0] - 1)), len(ids))
                n = part.num_rows
                loss = pc.equal(part.column("role"), LOSS_ROLE).to_numpy(zero_copy_only=False)
                roles = escape_role(part.column("role"))
                data, ends = assemble([fixed[0], spans.flat(roles), fixed[1], spans.flat(escape(part.column("text"))), fixed[2]], n)
                row_ends = np.concatenate([[0], ends[:, 4]]) if n else np.zeros(1, np.int64)
                cuts = row_ends[bounds]
                out = {"turn_ends": [], "loss_starts": [], "loss_ends": []}
                for a, b, start in zip(bounds[:-1], bounds[1:], cuts[:-1]):
                    out["turn_ends"].append(ends[a:b, 4] - start)
                    out["loss_starts"].append(ends[a:b, 2][loss[a:b]] - start)
                    out["loss_ends"].append(ends[a:b, 3][loss[a:b]] - start)
                chunk = (part.column("part")[0].as_py() << 33) + made + np.arange(len(bounds) - 1)
                made += len(bounds) - 1
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id").take(pa.array(bounds[:-1])), part.column("turn").take(pa.array(bounds[:-1])), pa.array(chunk), pa.array(np.diff(bounds)),
                     spans.strings(data, cuts, pa.string()), *(pa.array(x, pa.list_(pa.int32())) for x in out.values())],
                    names=["conv_id", "first_turn", "chunk", "n_turns", "formatted", *out])

    return rows.mapInArrow(run, CHUNK_SCHEMA)


def parse(chunk: dict) -> list[tuple[str, str, bool]]:
    """(role, text, under the loss mask) of each turn of a formatted chunk, from its bytes and ranges."""
    raw = chunk["formatted"].encode()
    masked = dict(zip(chunk["loss_starts"], chunk["loss_ends"]))
    turns, start = [], 0
    for end in chunk["turn_ends"]:
        piece = raw[start:end].decode()
        head, _, body = piece.removeprefix(START).removesuffix(END).partition(MIDDLE)
        at = start + len((START + head + MIDDLE).encode())
        loss = at in masked
        text = raw[at : masked[at]].decode() if loss else body
        turns.append((unescape(head), unescape(text), loss))
        start = end
    return turns


def digests(chunks: DataFrame) -> DataFrame:
    """Per conversation: n_turns, digests of all turns and of the text under the loss mask, and lengths in characters.

    A conversation's chunks meet in one task in their order and are digested one after the
    other, since a SHA-256 can only be taken in order; none is held beside the next.
    """
    rows = chunks.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("chunk"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, []

        def close() -> None:
            done.append((held[0], held[1], held[2].hexdigest(), held[3], held[4].hexdigest(), held[5]))

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if held is None or held[0] != row["conv_id"]:
                    if held:
                        close()
                    held = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, loss in parse(row):
                    held[1] += 1
                    held[2].update(f"{role}\n{text}\n".encode())
                    if loss:
                        held[3] += len(text)
                        held[4].update(text.encode())
                held[5] += len(row["formatted"])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), KINDS)], names=NAMES)
                done = []
        if held:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), KINDS)], names=NAMES)

    return rows.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
