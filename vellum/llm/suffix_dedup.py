"""Suffix-array deduplication: drop every byte covered by a ``length``-byte string that also starts in an earlier document.

Windows are the length-byte strings of a document; a document is earlier than another if its id is smaller (a null id is last).

1. Anchors. Each window is keyed by the least hash of its 24-byte pieces, so equal windows have equal keys. ``sharing``
   tells each chunk of documents which keys other documents hold; windows with other keys cannot repeat and need no sorting.
2. Shards. The windows left are cut into segments (runs of windows that agree in the least hash of their 12-byte pieces) and
   dealt to shards by that hash, so equal windows meet. Pieces that are found in very many places (``hot_pieces``) come after all
   others, so they deal only windows that hold nothing else. A chunk sends each distinct segment once, with its earliest document:
   a passage that every document holds costs one entry a chunk.
3. Suffix arrays. A shard sorts the suffixes of its distinct segments by induced sorting (``induced_sort``) and computes the
   permuted common prefixes: lengths carry from a position to the next, minus one. Neighbours that share length bytes
   form groups; the earliest document of a group goes back to the chunks whose segments hold a window of it.
4. Chunks mark the bytes of windows whose earliest document is smaller than their own.

All groups held in a task are of bounded size: chunks and shards number as many as the input needs. Texts over a megabyte
are keyed in overlapping pieces. Null texts are empty; texts shorter than length lose nothing. Documents with equal ids are not
earlier than each other. Empty tables give no rows; columns other than id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import sharing
from vellum.llm.induced_sort import permuted_prefixes, suffix_array
from vellum.llm.tables import chunks_for, text_bytes
from vellum.llm.textblock import BLOCK_BYTES, Block, U, blocks, cut, mix, power

LENGTH = 50
ANCHOR, SHARD_PIECE = 24, 12
CHUNK_TEXT, BUCKET_TEXT, SHARD_TEXT = 4 << 20, 16 << 20, 4 << 20
#: when a piece counts as hot, how many there may be, and of how many chunks one is looked at
HOT_SHARDS, MOST_HOT, SAMPLE_EVERY = 4, 20_000, 16
#: distinct text in one suffix array
ARRAY_TEXT = 250_000
LAST = np.iinfo(np.int64).max
SENT = "chunk int, shard int, text binary, lengths binary, parts binary, earliest binary"
SENT_NAMES = ["chunk", "shard", "text", "lengths", "parts", "earliest"]
FOUND = "chunk int, shard int, segment binary, start binary, windows binary, earliest binary"
FOUND_NAMES = ["chunk", "shard", "segment", "start", "windows", "earliest"]


def least_piece(prefix: np.ndarray, piece: int, length: int, hot: np.ndarray | None = None) -> np.ndarray:
    """For each window the least hash of its pieces of this size, by doubling; hot (hashes in order): pieces that come after all others."""
    n = len(prefix) - piece
    h = (prefix[piece:] - prefix[:-piece]) * power("down", n)
    if hot is not None and len(hot):
        is_hot = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
        h = (h >> U(1)) | (is_hot.astype(U) << U(63))
    size, want = 1, length - piece + 1
    while size * 2 <= want:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = want - size
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def pieces(column: pa.Array, length: int) -> Iterator[tuple[int, Block, int]]:
    """Blocks with the place of their bytes in the column's; a long text comes in pieces that overlap by length - 1 bytes."""
    at = 0
    for block in blocks(column):
        n = len(block.buf)
        if block.n == 1 and n > 2 * BLOCK_BYTES:
            for a in range(0, n - length + 1, BLOCK_BYTES):
                b = min(n, a + BLOCK_BYTES + length - 1)
                yield at + a, Block(block.first, block.buf[a:b], np.array([0, b - a])), block.first
        elif n >= length:
            yield at, block, block.first
        at += n


@dataclass
class Chunk:
    """A chunk's documents in the order of id and text, their bytes end to end, and the runs of windows with one anchor."""

    ids: np.ndarray
    buf: np.ndarray
    offs: np.ndarray
    parts: list[tuple]
    keys: np.ndarray
    many: np.ndarray


def read_chunk(table: pa.Table, length: int, segments: bool) -> Chunk:
    table = table.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")])
    text = table.column("text").combine_chunks()
    if isinstance(text, pa.ChunkedArray):
        text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.string())
    text = text.fill_null("")
    ids = table.column("doc_id").combine_chunks().fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
    whole = list(blocks(text, limit=1 << 62))
    buf, offs = (whole[0].buf, whole[0].offs) if whole else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    parts, key, doc = [], [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for at, block, first in pieces(text, length):
        prefix = block.prefix()
        anchor = least_piece(prefix, ANCHOR, length)
        bad = np.zeros(len(anchor) + 1, np.int32)
        inner = block.offs[1:-1]
        np.add.at(bad, np.clip(inner - length + 1, 0, len(anchor)), 1)
        np.add.at(bad, np.clip(inner, 0, len(anchor)), -1)
        valid = np.cumsum(bad)[:-1] == 0
        turn = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])])
        turn[np.clip(inner, 0, len(anchor) - 1)] = True
        run = np.flatnonzero(turn)
        size = np.diff(np.append(run, len(anchor)))
        good = valid[run]
        key.append(anchor[run[good]])
        doc.append(ids[first + np.searchsorted(block.offs, run[good], "right") - 1])
        parts.append((at, block, first, run, size, good, anchor[run], prefix if segments else None))
    key, doc = np.concatenate(key), np.concatenate(doc)
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    last = np.append(start[1:], len(key)) - 1
    return Chunk(ids, buf, offs, parts, key[start], doc[start] != doc[last] if len(key) else np.zeros(0, bool))


@dataclass
class Segments:
    """Segments of a chunk (place, windows, owner's id, kind) and their kinds (shard, number within it, place, bytes, part, earliest id)."""

    at: np.ndarray
    windows: np.ndarray
    ids: np.ndarray
    kind: np.ndarray
    shard: np.ndarray
    number: np.ndarray
    example: np.ndarray
    size: np.ndarray
    part: np.ndarray
    earliest: np.ndarray


def cut_segments(chunk: Chunk, level: np.ndarray, length: int, n_shards: int, hot: np.ndarray) -> Segments:
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, U)], [np.zeros(0, U)]]
    for at, block, first, run, size, good, anchor, prefix in chunk.parts:
        hold = good.copy()
        hold[good] = level[np.searchsorted(chunk.keys, anchor[good])] > 0
        p = np.flatnonzero(np.repeat(hold, size))
        if not len(p):
            continue
        key = least_piece(prefix, SHARD_PIECE, length, hot)[p]
        start = np.flatnonzero(np.concatenate([[True], (np.diff(p) != 1) | (key[1:] != key[:-1])]))
        s, n = p[start], np.diff(np.append(start, len(p)))
        for x, v in zip(out, (s + at, n, chunk.ids[first + np.searchsorted(block.offs, s, "right") - 1], cut(prefix, s, s + n + length - 1), mix(key[start])), strict=True):
            x.append(v)
    s, n, ids, h, key = (np.concatenate(x) for x in out)
    shard = ((key >> U(8)) % U(n_shards)).astype(np.int64)
    order = np.lexsort((ids, h, shard))
    first_of = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (shard[order][1:] != shard[order][:-1])]) if len(h) else np.zeros(0, bool)
    lead = order[first_of]
    kind = np.empty(len(h), np.int64)
    kind[order] = np.cumsum(first_of) - 1
    own = shard[lead]
    number = np.arange(len(lead)) - np.searchsorted(own, own)
    return Segments(s, n, ids, kind, own, number, s[lead], n[lead] + length - 1, (key[lead] & U(255)).astype(np.uint8), ids[lead])


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start[i] .. start[i] + size[i] - 1 for all i in turn."""
    total = int(size.sum())
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(total)


def levels_of(chunk: Chunk, side: pa.Table, split: sharing.Split) -> np.ndarray:
    rows = zip(side.column("bucket").to_pylist(), side.column("reply"), strict=True)
    return sharing.levels(chunk.keys, ((b, r.as_buffer()) for b, r in rows if b is not None), split)


def send_keys(length: int, split: sharing.Split):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        chunk = read_chunk(table, length, False)
        return sharing.messages(key[0].as_py(), chunk.keys, chunk.many, split)

    return run


def send_segments(length: int, split: sharing.Split, n_shards: int, hot: np.ndarray):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = read_chunk(left, length, True)
        g = cut_segments(chunk, levels_of(chunk, right, split), length, n_shards, hot)
        full, at = np.unique(g.shard, return_index=True)
        end = np.append(at[1:], len(g.shard))[: len(at)]
        rows = list(zip(at.tolist(), end.tolist(), strict=True))
        return pa.table([
            pa.array(np.full(len(full), key[0].as_py(), np.int32)), pa.array(full.astype(np.int32)),
            pa.array([chunk.buf[ragged(g.example[a:b], g.size[a:b])].tobytes() for a, b in rows], pa.binary()),
            pa.array([g.size[a:b].astype(np.int32).tobytes() for a, b in rows], pa.binary()),
            pa.array([g.part[a:b].tobytes() for a, b in rows], pa.binary()),
            pa.array([g.earliest[a:b].tobytes() for a, b in rows], pa.binary()),
        ], names=SENT_NAMES)

    return run


def earliest_windows(text: np.ndarray, start: np.ndarray, size: np.ndarray, earliest: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """One suffix array: for distinct segments, runs of windows with one earliest document (segment, start, windows, earliest)."""
    n = len(start)
    at = np.cumsum(size + 1) - size - 1
    raw = np.full(int(at[-1] + size[-1]) + 2, 0xFF, np.uint8)  # parts segments; no byte of UTF-8
    raw[-1] = 0xFE
    into = ragged(at, size)
    raw[into] = text[ragged(start, size)]
    s = raw.astype(np.int64) + 2
    s[raw == 0xFF] = 1
    s[-1] = 0
    sa = suffix_array(s, 258)
    windows = size - length + 1
    owner = np.full(len(s), -1, np.int64)
    owner[ragged(at, windows)] = np.repeat(np.arange(n), windows)
    # neighbours that share length bytes are of one group; no suffix that starts too late in its segment is among them
    group = np.cumsum(permuted_prefixes(raw, sa)[sa] < length)
    own = owner[sa] >= 0
    sa, group = sa[own], group[own]
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.minimum.reduceat(earliest[owner[sa]], head)
    value = np.empty(len(s), np.int64)
    value[sa] = np.repeat(least, np.diff(np.append(head, len(sa))))
    p = ragged(at, windows)
    v, o = value[p], owner[p]
    run = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (o[1:] != o[:-1])]))
    return o[run], p[run] - at[o[run]], np.diff(np.append(run, len(p))), v[run]


def sort_shard(length: int):
    def run(table: pa.Table) -> pa.Table:
        def joined(name: str, kind) -> tuple[np.ndarray, np.ndarray]:
            got = [np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]
            return np.concatenate(got), np.array([len(x) for x in got])

        text, _ = joined("text", np.uint8)
        size, counts = joined("lengths", np.int32)
        size = size.astype(np.int64)
        part, _ = joined("parts", np.uint8)
        own, _ = joined("earliest", np.int64)
        start = np.cumsum(size) - size
        h = cut(Block(0, text, np.array([0, len(text)])).prefix(), start, start + size)
        order = np.lexsort((h, part))
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (part[order][1:] != part[order][:-1])])
        lead = order[new]
        kind = np.empty(len(h), np.int64)
        kind[order] = np.cumsum(new) - 1
        earliest = np.minimum.reduceat(own[order], np.flatnonzero(new))
        # arrays of bounded size: windows that are equal are of one part
        bounds = np.flatnonzero(np.concatenate([[True], part[lead][1:] != part[lead][:-1]]))
        runs, a = [], 0
        for k, b in enumerate(np.append(bounds[1:], len(lead)).tolist()):
            if k == len(bounds) - 1 or size[lead[a:b]].sum() >= ARRAY_TEXT:
                o, s, n, v = earliest_windows(text, start[lead[a:b]], size[lead[a:b]], earliest[a:b], length)
                runs.append((o + a, s, n, v))
                a = b
        seg, s, n, v = (np.concatenate(x) for x in zip(*runs, strict=True))
        first = np.searchsorted(seg, np.arange(len(lead) + 1))
        # a sender knows the earliest of its own documents; it hears of segments where that is not the answer throughout
        several = np.diff(first)[kind] > 1
        told = several | (v[first[kind]] != own)
        message = np.repeat(np.arange(len(counts)), counts)
        number = np.arange(len(kind)) - np.repeat(np.cumsum(counts) - counts, counts)
        chunk, shard = table.column("chunk").to_numpy(), table.column("shard").to_numpy()
        out = [[], [], [], [], [], []]
        edge = np.searchsorted(message, np.arange(len(counts) + 1))
        for i in range(len(counts)):
            t = np.flatnonzero(told[edge[i] : edge[i + 1]]) + edge[i]
            if not len(t):
                continue
            a, m = first[kind[t]], np.diff(first)[kind[t]]
            r = ragged(a, m)
            for x, y in zip(out, (chunk[i], shard[i], np.repeat(number[t], m).astype(np.int32).tobytes(), s[r].astype(np.int32).tobytes(), n[r].astype(np.int32).tobytes(), v[r].tobytes()), strict=True):
                x.append(y)
        return pa.table([pa.array(x, k) for x, k in zip(out, (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=FOUND_NAMES)

    return run


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,length:bigint>>, kept_sha256 string"


def removed_bytes(chunk: Chunk, g: Segments, side: pa.Table, length: int) -> np.ndarray:
    """For each byte of the chunk whether it goes."""
    n_kinds = len(g.shard)
    reply = [(sh, *(np.frombuffer(x.as_buffer(), t) for x, t in zip(r, (np.int32, np.int32, np.int32, np.int64), strict=True))) for sh, *r in zip(side.column("shard").to_pylist(), *(side.column(c) for c in FOUND_NAMES[2:]), strict=True) if sh is not None]
    base = np.searchsorted(g.shard, [x[0] for x in reply])
    kind = np.concatenate([np.zeros(0, np.int64), *(x[1].astype(np.int64) + b for x, b in zip(reply, base, strict=True))])
    start, windows = (np.concatenate([np.zeros(0, np.int64), *(x[k].astype(np.int64) for x in reply)]) for k in (2, 3))
    value = np.concatenate([np.zeros(0, np.int64), *(x[4] for x in reply)])
    quiet = np.ones(n_kinds, bool)
    quiet[kind] = False
    q = np.flatnonzero(quiet)
    kind, start = np.concatenate([kind, q]), np.concatenate([start, np.zeros(len(q), np.int64)])
    windows, value = np.concatenate([windows, (g.size - length + 1)[q]]), np.concatenate([value, g.earliest[q]])
    order = np.lexsort((start, kind))
    kind, start, windows, value = kind[order], start[order], windows[order], value[order]
    first = np.searchsorted(kind, np.arange(n_kinds + 1))
    many = np.diff(first)[g.kind]
    r, own = ragged(first[g.kind], many), np.repeat(np.arange(len(g.kind)), many)
    hit = value[r] < g.ids[own]
    a = (g.at[own] + start[r])[hit]
    edge = np.zeros(len(chunk.buf) + 1, np.int32)
    np.add.at(edge, a, 1)
    np.add.at(edge, a + windows[r][hit] + length - 1, -1)
    return np.cumsum(edge)[:-1] > 0


def apply(length: int, split: sharing.Split, n_shards: int, hot: np.ndarray):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = read_chunk(left, length, True)
        g = cut_segments(chunk, levels_of(chunk, right, split), length, n_shards, hot)
        gone = removed_bytes(chunk, g, right, length)
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        edges = chunk.offs[:-1][chunk.offs[:-1] < len(gone)]
        opens[edges] = gone[edges]
        starts = np.flatnonzero(opens)
        total = np.concatenate([[0], np.cumsum(gone)])
        closes = gone.copy()
        closes[:-1] &= ~gone[1:]
        ends = chunk.offs[1:][chunk.offs[1:] > 0] - 1
        closes[ends] = gone[ends]
        stops = np.flatnonzero(closes) + 1
        at = np.searchsorted(starts, chunk.offs)
        size, removed, spans, digest = [], [], [], []
        for i, (a, b) in enumerate(zip(chunk.offs[:-1].tolist(), chunk.offs[1:].tolist(), strict=True)):
            lost = int(total[b] - total[a])
            size.append(b - a)
            removed.append(lost)
            spans.append([{"start": int(x) - a, "length": int(y - x)} for x, y in zip(starts[at[i] : at[i + 1]], stops[at[i] : at[i + 1]], strict=True)])
            text = chunk.buf[a:b]
            digest.append(hashlib.sha256(text[~gone[a:b]] if lost else text).hexdigest())
        span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        ids = pa.array(chunk.ids, pa.int64(), mask=chunk.ids == LAST)
        return pa.table([ids, pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"])

    return run


def count_pieces(length: int, least: float):
    """A chunk's pieces that are the least of at least so many windows, with their numbers."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, counts = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for _, block, _ in pieces(table.column("text").combine_chunks(), length):
            k, n = np.unique(least_piece(block.prefix(), SHARD_PIECE, length), return_counts=True)
            keys.append(k)
            counts.append(n)
        k, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate(counts), minlength=len(k)).astype(np.int64)
        full = n >= least
        return pa.table([pa.array(k[full].view(np.int64)), pa.array(n[full])], names=["piece", "n"])

    return run


def hot_pieces(texts: DataFrame, length: int, n_chunks: int, total: int) -> np.ndarray:
    """Pieces that would deal more than ``HOT_SHARDS`` shards' text to one shard, as estimated from some chunks; at most ``MOST_HOT``,
    for each takes at least that share of the text. They only tell how windows are dealt, not what is found."""
    heavy = max(HOT_SHARDS * SHARD_TEXT, total / MOST_HOT)
    if total <= heavy:
        return np.zeros(0, U)
    every = max(SAMPLE_EVERY, n_chunks // 64)
    share = heavy / total
    counts = texts.where(F.col("chunk") % every == 0).groupBy("chunk").applyInArrow(count_pieces(length, share * CHUNK_TEXT / 4), "piece bigint, n bigint")
    found = counts.groupBy("piece").agg(F.sum("n").alias("n")).where(F.col("n") >= share * CHUNK_TEXT * (-(-n_chunks // every))).select("piece").collect()
    return np.sort(np.array([r["piece"] for r in found], np.int64).view(U))


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, the removed spans (byte offsets) and the SHA-256 of what is kept.
    length: at least ANCHOR + 1 bytes."""
    n_rows, total = text_bytes(docs, text_col)
    n_chunks, n_shards, split = chunks_for(total + 64 * n_rows, CHUNK_TEXT), chunks_for(total, SHARD_TEXT), sharing.split(total, BUCKET_TEXT)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), sharing.chunk_of(n_chunks, id_col, text_col).alias("chunk"))
    by_chunk = texts.groupBy("chunk")
    replies = sharing.shared(by_chunk.applyInArrow(send_keys(length, split), sharing.MESSAGE), split)
    hot = hot_pieces(texts, length, n_chunks, total)
    sent = by_chunk.cogroup(replies.groupBy("chunk")).applyInArrow(send_segments(length, split, n_shards, hot), SENT)
    found = sent.groupBy("shard").applyInArrow(sort_shard(length), FOUND)
    side = replies.unionByName(found, allowMissingColumns=True)
    return by_chunk.cogroup(side.groupBy("chunk")).applyInArrow(apply(length, split, n_shards, hot), RESULT)


def digest(result: DataFrame) -> DataFrame:
    """What op7 returns."""
    return result.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


ORACLE = """
with h as (select doc_id, hex(encode(coalesce(text, ''))) x, octet_length(encode(coalesce(text, '')))::bigint n from documents),
pc as (select doc_id, n, j, substr(x, 1000 * j + 1, 1098) s from (select doc_id, n, x, unnest(range(0, n // 500 + 1)) j from h)),
w as (select doc_id, 500 * j + i p, hash(substr(s, 2 * i - 1, 100)) k from (select doc_id, n, j, s, unnest(range(1, 501)) i from pc) where 500 * j + i <= n - 49),
f as (select k, min(doc_id) m from w group by k),
g as (select doc_id, p from w join f using (k) where m < doc_id),
y as (select doc_id, unnest(range(1, n + 1)) q, unnest(regexp_extract_all(x, '..')) v from h),
c as (select y.*, coalesce(max(case when g.p is not null then 1 end) over (partition by y.doc_id order by q rows between 49 preceding and current row), 0) gone from y left join g on y.doc_id = g.doc_id and y.q = g.p),
e as (select *, gone = 1 and coalesce(lag(gone) over (partition by doc_id order by q), 0) = 0 opens from c),
r as (select doc_id, sum(gone)::bigint n_removed, count(*) filter (where opens)::bigint n_spans, coalesce(string_agg(v, '' order by q) filter (where gone = 0), '') kept from e group by doc_id)
select doc_id, n n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(kept, ''))) kept_sha256 from h left join r using (doc_id)
"""
