"""Putting texts, sized in tokens, into sequences of fixed capacity.

Texts are dealt to shards by a hash, each shard small enough for one task and large enough to pack well. In a shard
they are packed hierarchically over several context sizes, the capacity and its halves: each item is routed to the
smallest context size that holds it, the windows of each size are packed from the longest size to the shortest, and
the gap of a window is filled with the longest items of the shorter tiers that fit. Windows, from the longest on, are
joined to sequences of the capacity and follow each other without a gap. Sequences are dealt to step groups of equal
size in snake order of their attention cost, so that steps take equal time.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evifold.plans.checkpoints import cut_lineage

CAPACITY, TIERS, STEP_SIZE = 2_048, 3, 32
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Tokens that a shard holds on average: a bound on the memory of a task and on the room lost at the shards' ends.
SHARD_TOKENS = 16_000_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Place of a public vocabulary file: a path as it is, a bare name in the folder of the installed package."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=4)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str) -> int:
    """Number of tokens of ``text``; 0 for an empty one. Special tokens are ordinary text here."""
    return len(_encoding(path).encode_ordinary(text)) if text else 0


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(item_id, n_tokens) of every row with at least one token; NULL and empty texts have none and give no row."""
    path = vocabulary_path(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for batch in batches:
            sizes = np.fromiter((len(encode(t)) for t in batch.column(1).to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes)], names=["item_id", "n_tokens"])

    rows = df.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("body"))
    return rows.where("length(body) > 0").mapInArrow(count, "item_id bigint, n_tokens bigint")


def context_sizes(capacity: int, tiers: int) -> list[int]:
    """The capacity and its halves, at most ``tiers`` sizes; an odd size is not halved, as its halves would not fill it."""
    sizes = [capacity]
    while len(sizes) < tiers and sizes[-1] % 2 == 0:
        sizes.append(sizes[-1] // 2)
    return sizes


def pack_shard(sizes: np.ndarray, capacity: int, tiers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For items of 1..capacity tokens in a fixed order: the sequence, the place in it, and the tier of the window of each.

    Tier k has windows of ``context_sizes(capacity, tiers)[k]`` tokens. From the longest tier on, the longest item left
    that needs this tier opens a window, and its gap is filled with the longest items left that fit, which all come from
    shorter tiers or the same one. The lists of equal sizes are stacks; which sizes are left is read from one integer as a
    set of bits, so that finding the longest item that fits takes one step.
    """
    n = len(sizes)
    order = np.argsort(sizes, kind="stable")
    bounds = np.searchsorted(sizes[order], np.arange(capacity + 2))
    left = (bounds[1:] - bounds[:-1]).tolist()
    top = bounds[1:].tolist()
    have = 0
    for size in np.flatnonzero(np.asarray(left)).tolist():
        have |= 1 << size
    order = order.tolist()
    seq, place, tier = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    windows = context_sizes(capacity, tiers)
    start = filled = 0  # of the window, over all sequences end to end, and tokens in its sequence so far
    for k, window in enumerate(windows):
        least = windows[k + 1] if k + 1 < len(windows) else 0
        while have >> (least + 1):
            room = window
            while room and (fitting := have & ((1 << (room + 1)) - 1)):
                size = fitting.bit_length() - 1
                top[size] -= 1
                item = order[top[size]]
                left[size] -= 1
                if not left[size]:
                    have ^= 1 << size
                seq[item], place[item], tier[item] = start // capacity, filled, k
                room -= size
                filled += size
            start += window
            if start % capacity == 0:
                filled = 0
    return seq, place, tier


def balanced_steps(cost: np.ndarray, step_size: int) -> np.ndarray:
    """Step group of each sequence: groups of at most ``step_size``, dealt in snake order of cost, so that sums are close."""
    n = len(cost)
    groups = -(-n // step_size)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((np.arange(n), -cost))] = np.arange(n)
    lap, at = rank // max(groups, 1), rank % max(groups, 1)
    return np.where(lap % 2 == 0, at, groups - 1 - at)


def pack(df: DataFrame, id_col: str = "item_id", size_col: str = "n_tokens", capacity: int = CAPACITY, tiers: int = TIERS, step_size: int = STEP_SIZE) -> DataFrame:
    """(shard, seq_no, step_group, tier, item_id, part_no, first_token, n_tokens, seq_start): every token of every item once.

    ``tier`` is that of the window an item lies in, whose context size is the capacity halved ``tier`` times.
    An item of more than ``capacity`` tokens alone is divided: full sequences of it first, its rest is packed as an
    item of its own. All others stay whole. NULL ids or sizes and sizes under 1 give no row; rows that are equal are
    packed as often as they stand there; an empty table gives no rows. Ties are broken by id, part and copy, so a
    run repeats. Extra columns are never read.
    """
    if capacity < 1 or step_size < 1 or tiers < 1:
        raise ValueError("capacity, step_size and tiers must be positive")
    items = df.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(size_col).cast("bigint").alias("size"))
    items = cut_lineage(items.where("item_id is not null and size > 0"))
    total = items.agg(F.sum("size")).first()[0] or 0
    shards = max(1, round(total / SHARD_TOKENS))
    parts = items.select(
        F.pmod(F.xxhash64("item_id", F.lit(17)), F.lit(shards)).cast("int").alias("shard"), "item_id",
        F.explode(F.sequence(F.lit(0), ((F.col("size") - 1) / capacity).cast("int"))).alias("part_no"), "size",
    )
    parts = parts.select("shard", "item_id", "part_no", F.least(F.lit(capacity), F.col("size") - F.col("part_no") * capacity).cast("int").alias("n_tokens"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item_id", "part_no", "n_tokens"], kind="stable").reset_index(drop=True)
        sizes = pdf["n_tokens"].to_numpy(np.int64)
        seq, place, tier = pack_shard(sizes, capacity, tiers)
        cost = np.bincount(seq, weights=sizes.astype(float) ** 2)
        return pd.DataFrame(
            {
                "shard": pdf["shard"], "seq_no": seq, "step_group": balanced_steps(cost, step_size)[seq], "tier": tier, "item_id": pdf["item_id"],
                "part_no": pdf["part_no"], "first_token": pdf["part_no"].to_numpy(np.int64) * capacity, "n_tokens": sizes, "seq_start": place,
            }
        )

    schema = "shard int, seq_no bigint, step_group bigint, tier int, item_id bigint, part_no int, first_token bigint, n_tokens bigint, seq_start bigint"
    return parts.groupBy("shard").applyInPandas(run, schema)
