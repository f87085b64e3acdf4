"""Which hashes occur in more than one place? Answered for whole corpora with dense messages instead of one row a hash.

Documents are dealt to chunks of a few megabytes of text. A chunk sorts its distinct hashes and sends each bucket (hash range)
one message with the low 32 bits of its hashes there. A bucket sorts what it got and answers each chunk, one byte a hash: the
binary logarithm of the number of holders, as far as told (0: nobody else has it). Hot hashes cost a chunk one entry each. A bucket
takes log2(number of buckets) bits off the hash and the number of buckets follows the input, so the chance that two
different hashes are taken for one stays about one in thousands at any size; it makes a hash look shared that is not, never the reverse.

Chunks times buckets grow with the square of the input. From ``ONE_LEVEL`` buckets on, messages therefore go in two steps: chunks send
to the square root as many groups of buckets, as many chunks at a time are merged there and go on to the buckets as one sender, and
answers come back the same way. A message then holds some hundred hashes or more up to 100 TB.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.tables import chunks_for, written
from vellum.llm.textblock import U

CHUNK_BYTES = 4 << 20
MESSAGE = "chunk int, bucket int, hashes binary, many binary"
REPLY = "chunk int, bucket int, reply binary"
MESSAGE_NAMES, REPLY_NAMES = ["chunk", "bucket", "hashes", "many"], ["chunk", "bucket", "reply"]


def chunk_of(n_chunks: int, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n_chunks)).cast("int")


#: buckets up to which chunks write to each of them
ONE_LEVEL = 4096


class Split(NamedTuple):
    """How many buckets there are, and how many groups of them chunks write to (as many, with one level)."""

    buckets: int
    top: int


def split(total: int, each: int) -> Split:
    n = chunks_for(total, each)
    return Split(n, n if n <= ONE_LEVEL else math.ceil(math.sqrt(n)))


def bucket_order(u: np.ndarray, s: Split) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ascending hashes: their buckets, the order by group of buckets (ascending within), and where each group starts (top + 1)."""
    bucket = ((u >> U(36)) % U(s.buckets)).astype(np.int32)
    top = bucket % s.top
    order = np.argsort(top, kind="stable")
    return bucket, order, np.searchsorted(top[order], np.arange(s.top + 1))


def packed(senders: np.ndarray, buckets: np.ndarray, hashes: list[bytes], many: list[np.ndarray]) -> pa.Table:
    return pa.table([pa.array(senders.astype(np.int32)), pa.array(buckets.astype(np.int32)), pa.array(hashes, pa.binary()), pa.array([np.packbits(x).tobytes() for x in many], pa.binary())], names=MESSAGE_NAMES)


def messages(chunk: int, u: np.ndarray, many: np.ndarray, s: Split) -> pa.Table:
    """u: the chunk's distinct hashes, ascending; many: those that several of its documents have."""
    bucket, order, at = bucket_order(u, s)
    low, many = u[order].astype(np.uint32), many[order]
    if s.top < s.buckets:
        low = low.astype(U) | (bucket[order] // s.top).astype(U) << U(32)
    full = np.flatnonzero(at[1:] > at[:-1])
    return packed(np.full(len(full), chunk), full, [low[at[b] : at[b + 1]].tobytes() for b in full], [many[at[b] : at[b + 1]] for b in full])


def unpacked(table: pa.Table, kind) -> tuple[list[np.ndarray], list[np.ndarray]]:
    parts = [np.frombuffer(x.as_buffer(), kind) for x in table.column("hashes")]
    return parts, [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(p)) for x, p in zip(table.column("many"), parts, strict=True)]


def answer(table: pa.Table) -> pa.Table:
    """One bucket: all its messages in, an answer to each out."""
    parts, flags = unpacked(table, np.uint32)
    low = np.concatenate(parts)
    order = np.argsort(low)
    ordered = low[order]
    start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    holders = np.add.reduceat(1 + np.concatenate(flags)[order].astype(np.int64), start)
    level = np.minimum(np.floor(np.log2(holders)), 63).astype(np.uint8)
    out = np.empty(len(low), np.uint8)
    out[order] = np.repeat(level, np.diff(np.concatenate([start, [len(low)]])))
    return replied(table, parts, out)


def replied(table: pa.Table, parts: list[np.ndarray], out: np.ndarray) -> pa.Table:
    ends = np.cumsum([len(p) for p in parts])
    return pa.table([table.column("chunk").combine_chunks(), table.column("bucket").combine_chunks(), pa.array([out[e - len(p) : e].tobytes() for p, e in zip(parts, ends, strict=True)], pa.binary())], names=REPLY_NAMES)


def merge(s: Split):
    """Some chunks' messages to a group of buckets become one message to each of its buckets."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts, flags = unpacked(table, U)
        v, place, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        many = (count > 1) | (np.bincount(place, weights=np.concatenate(flags), minlength=len(v)) > 0)
        sub = (v >> U(32)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], sub[1:] != sub[:-1]]))
        stop = np.append(start[1:], len(v))
        runs = list(zip(start.tolist(), stop.tolist(), strict=True))
        return packed(np.full(len(runs), key[0].as_py()), sub[start] * s.top + key[1].as_py(), [v[a:b].astype(np.uint32).tobytes() for a, b in runs], [many[a:b] for a, b in runs])

    return run


def hand_back(s: Split):
    """The buckets' answers to some chunks together, parted among them."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        parts, _ = unpacked(left, U)
        v, place = np.unique(np.concatenate(parts), return_inverse=True)
        sub = (v >> U(32)).astype(np.int64)
        level = np.zeros(len(v), np.uint8)
        for bucket, reply in zip(right.column("bucket").to_pylist(), right.column("reply"), strict=True):
            a = int(np.searchsorted(sub, bucket // s.top))
            got = np.frombuffer(reply.as_buffer(), np.uint8)
            level[a : a + len(got)] = got
        return replied(left, parts, level[place])

    return run


def shared(sent: DataFrame, s: Split) -> DataFrame:
    """From MESSAGE rows to REPLY rows."""
    if s.top == s.buckets:
        return sent.groupBy("bucket").applyInArrow(answer, REPLY)
    sent = written(sent, "messages").withColumn("group", F.floor(F.col("chunk") / s.top).cast("int"))
    answers = sent.groupBy("group", "bucket").applyInArrow(merge(s), MESSAGE).groupBy("bucket").applyInArrow(answer, REPLY)
    answers = answers.select(F.col("chunk").alias("group"), (F.col("bucket") % s.top).cast("int").alias("top"), "bucket", "reply")
    return sent.groupBy("group", "bucket").cogroup(answers.groupBy("group", "top")).applyInArrow(hand_back(s), REPLY)


def levels(u: np.ndarray, replies: Iterator[tuple[int, bytes]], s: Split) -> np.ndarray:
    """The answers put together again: a level for each of the chunk's hashes u."""
    _, order, at = bucket_order(u, s)
    out = np.zeros(len(u), np.uint8)
    for bucket, data in replies:
        out[order[at[bucket] : at[bucket + 1]]] = np.frombuffer(data, np.uint8)
    return out
