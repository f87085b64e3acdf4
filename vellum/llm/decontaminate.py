"""Benchmark decontamination with suffix arrays over the training text.

Each task turns the texts it reads into shards of word codes and builds a sparse suffix array over every shard: the
suffixes whose first two words open some benchmark window, in order of their first ``window`` words (other suffixes
cannot match). Every benchmark suffix is then binary-searched in every shard, all at once. The ranges found give the
locations; following text and item on from there gives the verbatim match in full. There is no shuffle: the benchmark side travels to
the tasks in pieces of bounded size (``piece_bytes``), ``PIECES`` of them in one narrow pass over the texts. A longer benchmark takes more
passes, the state of the documents written in between; the driver and the tasks hold the pieces of one pass only.
Work and results are linear in the windows found: each window has one place, and items of equal words are one.

Words are maximal runs of digits, letters a-z after lower-casing A-Z, and non-ASCII characters. A window is ``window``
consecutive words of an item; an item with fewer words (but some) is one window. Null texts have no words. A document's hit
words are those inside any occurrence of any window. Repeated documents are judged alike, each in its own row; empty tables
give no rows, an empty benchmark gives no hits. Columns of the documents beyond id and text pass through ``decontaminate``.
Words are compared by 64-bit hashes of their bytes, ten in a row for a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.tables import free, written
from vellum.llm.textblock import IS_ALNUM, U, blocks, mix, words

WINDOW = 10
#: windows of a piece take some forty times its bytes while they are built
PIECE_BYTES, PIECES = 1 << 20, 8
#: shards are some blocks of text; longer shards make fewer searches
SHARD_BYTES = 2 << 20


class TestWindows:
    """The distinct windows of some items: codes (one row a window, depth words of it used), one place of each, and the items that
    hold it. Items of equal words form one class. ``line`` has the windows of the longer classes, one after the other."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window = window
        texts: dict[bytes, list] = {}
        for block in blocks(pa.array([x[1] for x in items], pa.string())):
            _, _, first, hashes = words(block, IS_ALNUM, lower=True)
            for k in range(block.n):
                own = hashes[first[k] : first[k + 1]]
                if len(own):
                    texts.setdefault(own.tobytes(), [own, set()])[1].add(items[block.first + k][0])
        self.ids = [sorted(x[1]) for x in texts.values()]
        sequences = [x[0] for x in texts.values()]
        size = np.array([len(x) for x in sequences], np.int64)
        short, full = np.flatnonzero(size < window), np.flatnonzero(size >= window)
        rows = [np.zeros((0, window), U)]
        rows += [np.lib.stride_tricks.sliding_window_view(sequences[c], window) for c in full]
        rows += [np.concatenate([sequences[c], np.zeros(window - size[c], U)])[None, :] for c in short]
        codes = np.concatenate(rows)
        count = np.concatenate([size[full] - window + 1, np.ones(len(short), np.int64)])
        holder = np.repeat(np.concatenate([full, short]), count)
        depth = np.minimum(size[holder], window)
        h = depth.astype(U)
        for j in range(window):
            h = mix(h * U(0x9E3779B97F4A7C15) + codes[:, j])
        _, at, number = np.unique(h, return_index=True, return_inverse=True)
        self.codes, self.depth, self.place = codes[at], depth[at], at
        self.line, self.holder = number, holder
        self.start = np.zeros(len(sequences), np.int64)
        self.start[np.concatenate([full, short])] = np.cumsum(count) - count
        held = np.unique(np.stack([number, holder]), axis=1)
        self.members, self.member_at = held[1], np.searchsorted(held[0], np.arange(len(at) + 1))
        one = self.depth == 1
        self.openers = np.unique(pair(self.codes[~one, 0], self.codes[~one, 1])) if window > 1 else np.zeros(0, U)
        self.singles = np.unique(self.codes[one, 0])
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.openers & U((1 << 20) - 1)).astype(np.int64)] = True

    def matches(self, at: np.ndarray, which: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """Verbatim matches (document, class, position, place in the class, words): each window found is followed from its place as
        far as text and item agree. at: positions in order; which: the windows there. Every window found is in one match."""
        place = -1
        last = (-1, -1)
        begin = out = None
        for p, k, d in zip(at.tolist(), which.tolist(), doc.tolist(), strict=True):
            if self.depth[k] < self.window:
                yield d, int(self.holder[self.place[k]]), p, 0, int(self.depth[k])
                continue
            goes_on = last == (d, p - 1) and place + 1 < len(self.line) and self.holder[place + 1] == self.holder[place] and self.line[place + 1] == k
            if goes_on:
                place += 1
            else:
                if out is not None:
                    yield *out, self.window + last[1] - begin
                place, begin = int(self.place[k]), p
                c = int(self.holder[place])
                out = (d, c, p, place - int(self.start[c]))
            last = (d, p)
        if out is not None:
            yield *out, self.window + last[1] - begin


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a + U(0x9E3779B97F4A7C15) * b)


def among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def suffix_array(codes: np.ndarray, left: np.ndarray, tests: TestWindows) -> tuple[np.ndarray, np.ndarray]:
    """The shard's sparse suffix array and its suffixes' first words. left: words from here to the end of the text."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros((0, tests.window), U)
    opener = pair(codes, np.concatenate([codes[1:], np.zeros(1, U)]))
    at = np.flatnonzero(tests.sieve[(opener & U((1 << 20) - 1)).astype(np.int64)])
    at = at[among(opener[at], tests.openers) & (left[at] >= 2)]
    if len(tests.singles):
        at = np.union1d(at, np.flatnonzero(among(codes, tests.singles)))
    steps = at[:, None] + np.arange(tests.window)[None, :]
    rows = np.where(np.arange(tests.window)[None, :] < left[at][:, None], codes[np.minimum(steps, n - 1)], U(0))
    order = np.lexsort(rows.T[::-1])
    return at[order], rows[order]


def search(rows: np.ndarray, tests: TestWindows) -> tuple[np.ndarray, np.ndarray]:
    """For each test suffix the range of the suffix array that starts with it: two binary searches, all suffixes at once."""

    def bound(right: bool) -> np.ndarray:
        lo, hi = np.zeros(len(tests.codes), np.int64), np.full(len(tests.codes), len(rows), np.int64)
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) // 2
            a, b = rows[mid], tests.codes[live]
            differ = (a != b) & (np.arange(tests.window)[None, :] < tests.depth[live][:, None])
            where = differ.argmax(1)
            r = np.arange(len(live))
            less = np.where(differ[r, where], a[r, where] < b[r, where], right)
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        return lo

    return bound(False), bound(True)


MATCH = "array<struct<item_id:string,start:bigint,item_start:bigint,words:bigint>>"
STATE = {"n_words": "bigint", "n_hit": "bigint", "hit_words": "binary", "items": "array<string>", "matches": MATCH}
ARROW = {"n_words": pa.int64(), "n_hit": pa.int64(), "hit_words": pa.binary(), "items": pa.list_(pa.string()), "matches": pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("item_start", pa.int64()), ("words", pa.int64())]))}


def hits(codes: np.ndarray, left: np.ndarray, t: TestWindows) -> tuple[np.ndarray, np.ndarray]:
    """Where windows occur in a shard, in order of position: positions and windows."""
    sa, rows = suffix_array(codes, left, t)
    lo, hi = search(rows, t)
    k = np.flatnonzero(lo < hi)
    many = (hi - lo)[k]
    at = sa[np.repeat(lo[k] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))]
    which = np.repeat(k, many)
    order = np.lexsort((which, at))
    return at[order], which[order]


def scan(tests, text_col: str, shard_bytes: int, state: dict[str, str], last: bool):
    """A pass over the documents that adds the hits on some pieces of the benchmark to the state columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [] for c in STATE}
            was_hit, was_items, was = (batch.column(state[c]).to_pylist() for c in ("hit_words", "items", "matches"))
            for block in blocks(batch.column(text_col), shard_bytes):
                _, _, first, codes = words(block, IS_ALNUM, lower=True)
                left = np.repeat(first[1:], np.diff(first)) - np.arange(len(codes))
                mark = np.zeros(len(codes) + 1, np.int32)
                items: dict[int, set[str]] = {}
                own: dict[int, list[dict]] = {}
                for t in tests.value:
                    at, which = hits(codes, left, t)
                    if not len(at):
                        continue
                    np.add.at(mark, at, 1)
                    np.add.at(mark, at + t.depth[which], -1)
                    doc = np.searchsorted(first, at, "right") - 1
                    for d, c, p, q, n in t.matches(at, which, doc):
                        own.setdefault(d, []).append({"item_id": t.ids[c][0], "start": p - int(first[d]), "item_start": q, "words": n})
                    for d, k in np.unique(np.stack([doc, which]), axis=1).T.tolist():
                        found = items.setdefault(d, set())
                        for c in t.members[t.member_at[k] : t.member_at[k + 1]].tolist():
                            found.update(t.ids[c])
                hit = np.cumsum(mark)[:-1] > 0
                for k in range(block.n):
                    r = block.first + k
                    mine = hit[first[k] : first[k + 1]]
                    if was_hit[r]:
                        mine = mine | np.unpackbits(np.frombuffer(was_hit[r], np.uint8), count=len(mine)).astype(bool)
                    n = int(mine.sum())
                    out["n_words"].append(len(mine))
                    out["n_hit"].append(n)
                    out["hit_words"].append(np.packbits(mine).tobytes() if n else None)
                    out["items"].append(sorted(items.get(k, set()).union(was_items[r] or ())))
                    out["matches"].append((was[r] or []) + own.get(k, []))
            new = {state[c]: pa.array(x, ARROW[c]) for c, x in out.items()}
            names = [c for c in batch.schema.names if not last or c != text_col]
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names=names)

    return run


def piece_groups(bench: DataFrame, id_col: str, text_col: str, piece_bytes: int) -> Iterator[tuple[bool, list[list[tuple[str, str]]]]]:
    """Whether more follow, and up to ``PIECES`` pieces of the benchmark of about piece_bytes each; the driver holds no others."""
    items = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-total // piece_bytes))
    items = items.withColumn("k", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
    for k in range(0, n, PIECES):
        parts: list[list[tuple[str, str]]] = [[] for _ in range(min(PIECES, n - k))]
        for r in items.where((F.col("k") >= k) & (F.col("k") < k + PIECES)).collect():
            parts[r["k"] - k].append((r["i"], r["t"]))
        yield k + PIECES < n, parts


def find_contamination(docs: DataFrame, bench: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, piece_bytes: int = PIECE_BYTES, shard_bytes: int = SHARD_BYTES, keep_text: bool = False) -> DataFrame:
    """The documents' columns (the text only if asked for) and n_words, n_hit, hit_words (bits, null without hits), items (all that
    have a window in the document) and matches: verbatim matches that cover all windows found, as long as text and item agree from the
    place of the first window, each with its item (of several the first), first word, first word in the item, and length in words."""
    state = {}
    for c in STATE:
        state[c] = free(c if c not in docs.columns else f"_found_{c}", [*docs.columns, *state.values()])
    df = docs.select(*(F.col(f"`{c}`") for c in docs.columns), *(F.lit(0 if t == "bigint" else None).cast(t).alias(state[c]) for c, t in STATE.items()))
    for more, parts in piece_groups(bench, item_id, item_text, piece_bytes):
        tests = docs.sparkSession.sparkContext.broadcast([TestWindows(part, window) for part in parts])
        last = not more and not keep_text
        df = df.mapInArrow(scan(tests, text_col, shard_bytes, state, last), df.drop(text_col).schema if last else df.schema)
        if more:
            df = written(df, "hits")
            tests.destroy()
    return df


def decontaminate(docs: DataFrame, bench: DataFrame, *, text_col: str = "text", max_hit: int = 0, **options) -> DataFrame:
    """The documents with at most max_hit words inside benchmark windows, all their columns as they were."""
    found = find_contamination(docs, bench, text_col=text_col, keep_text=True, **options)
    n_hit = found.columns[len(docs.columns) + list(STATE).index("n_hit")]
    return found.where(F.col(n_hit) <= max_hit).select(*docs.columns)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What op4 returns."""
    items = F.array_sort("items")
    return found.select(
        F.col(id_col).alias("doc_id"), "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
with lo as (select 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' a, 'abcdefghijklmnopqrstuvwxyz' z),
dw as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), a, z), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents, lo),
iw as (select coalesce(item_id::varchar, '') item, regexp_extract_all(translate(coalesce(text, ''), a, z), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark, lo),
ip as (select item, w, least(len(w), 10) n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) p from iw where len(w) > 0),
win as (select distinct item, n, array_to_string(w[p:p + n - 1], ' ') k from ip),
sz as (select distinct n from win),
dp as (select rid, w, n, unnest(range(1, len(w) - n + 2)) p from dw, sz where len(w) >= n),
hit as (select rid, p, d.n, item from (select rid, p, n, array_to_string(w[p:p + n - 1], ' ') k from dp) d join win on d.n = win.n and d.k = win.k),
wd as (select rid, count(distinct q)::bigint n_hit from (select rid, unnest(range(p, p + n)) q from hit) group by rid),
it as (select rid, count(distinct item)::bigint n_items, string_agg(distinct item, ',' order by item) items from hit group by rid)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join wd using (rid) left join it using (rid)
"""
