"""N-gram Jaccard self-join as a blocked sparse matrix product of the document by n-gram incidence.

Two texts link when the Jaccard similarity of their sets of distinct five-word shingles is at least 0.8. The product of the incidence
matrix with its transpose holds every overlap; it is computed in blocks, without the entries that cannot count:

1. Equal rows (texts with equal shingle sets) become one class.
2. Columns held by one class drop out (``sharing``). A class needs a partner for ceil(0.8 n) of its n shingles, so a
   class with fewer shared columns has no link. What remains are the candidate rows.
3. Prefix columns find families. With columns ordered from rare to common, linked rows share one of their first
   n - ceil(0.8 n) + 1. A column block joins the rows that share one of its columns, as far as their sizes allow 0.8, each to one
   of them (not to each other), first within each batch of rows, then the batches' runs; the connected parts are the
   families, and no link leaves its family.
4. A family of more than ``BLOCK_ROWS`` rows or ``BLOCK_SHINGLES`` shingles is first multiplied with the pivots of its min-hash groups,
   one product a row and pivot, so that most of a large group of near copies becomes one component at once.
5. Each family is multiplied out in full, in pairs of row blocks, whose rows are kept together by component; blocks of one and the same
   component say nothing new and are not multiplied. Overlap counts accumulate row by row inside the task; pairs below
   the bound that follows from their sizes are dropped there, and of the others one link for each two components joined is returned.

Every link is in a family, and every pair of a family that may join two components is multiplied, so components are those of all
links. The operator returns them for each document; copies and near copies are not expanded into pairs.

Words are runs of characters other than space and U+0009-U+000D, A-Z lower-cased. With fewer than five words the whole
sequence is the only shingle; without words (or text) the set is empty and links with nothing, and the document is its own component. Shingles
and sets are compared by 64-bit hashes. Repeated rows belong to one class; a null id never is a component's id unless the
component has no other. Empty tables give no rows; columns other than id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import sharing
from vellum.llm.components import connected_components
from vellum.llm.tables import as_row, chunks_for, hashable, text_bytes, written
from vellum.llm.textblock import NOT_SPACE, U, blocks, mix, shingles, words

PERCENT = 80
PIVOTS = 4
BUCKET_TEXT = 8 << 20
BLOCK_ROWS, BLOCK_SHINGLES = 1000, 2_000_000
SALT_ROWS = 10_000
SEEDS = mix(np.arange(1, PIVOTS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    for block in blocks(column):
        _, _, first, hashes = words(block, NOT_SPACE, lower=True)
        yield from shingles(first, hashes)


def set_key(s: np.ndarray) -> int:
    """64-bit hash of a set."""
    return int((mix(s).sum(dtype=U) ^ mix(s + U(len(s))).sum(dtype=U)).view(np.int64)) if len(s) else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, chunk, r (hash of the row), n (set size) and node (hash of the set)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(s), set_key(s)) for s in shingle_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("chunk"), batch.column("r"), pa.array([x[0] for x in sets], pa.int64()), pa.array([x[1] for x in sets], pa.int64())], names=["doc_id", "chunk", "r", "n", "node"])

    return docs.mapInArrow(run, f"doc_id {id_type}, chunk int, r bigint, n bigint, node bigint")


def chosen_sets(left: pa.Table, nodes: set[int]) -> tuple[list[int], list[np.ndarray]]:
    """The sets in a chunk that stand for their class, each once."""
    found: dict[int, np.ndarray] = {}
    for s in shingle_sets(left.column("text")):
        if len(s) and (k := set_key(s)) in nodes:
            found[k] = s
    return list(found), list(found.values())


def distinct(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not sets:
        return np.zeros(0, U), np.zeros(0, bool)
    u, n = np.unique(np.concatenate(sets), return_counts=True)
    return u, n > 1


def send(split: sharing.Split):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        _, sets = chosen_sets(left, set(right.column("node").to_pylist()))
        return sharing.messages(key[0].as_py(), *distinct(sets), split)

    return run


CANDIDATE = "node bigint, n bigint, sh binary, prefix binary, mh array<bigint>"


def needed(n: int) -> int:
    """Shingles that a set of n must share with one it links with: overlap >= 0.8 union >= 0.8 n."""
    return -(-PERCENT * n // 100)


def select(split: sharing.Split):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        nodes = right.column("node").to_pylist()
        names, sets = chosen_sets(left, {x for x in nodes if x is not None})
        u, _ = distinct(sets)
        level = sharing.levels(u, ((b, d) for x, b, d in zip(nodes, right.column("bucket").to_pylist(), right.column("reply").to_pylist(), strict=True) if x is None), split)
        out: list[tuple] = []
        for node, s in zip(names, sets, strict=True):
            own = level[np.searchsorted(u, s)]
            if (own > 0).sum() >= needed(len(s)):
                order = np.lexsort((s, own))
                prefix = order[: len(s) - needed(len(s)) + 1]
                prefix = s[prefix[own[prefix] > 0]]
                out.append((node, len(s), s.tobytes(), prefix.tobytes(), [int(mix(s ^ k).min().view(np.int64)) for k in SEEDS]))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["node", "n", "sh", "prefix", "mh"])

    return run


def candidates(docs: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """Steps 1 and 2: the rows that may link. docs: text, chunk; classes: node and chunk of its first document."""
    split = sharing.split(total, BUCKET_TEXT)
    texts = docs.select("chunk", "text")
    asked = classes.select("chunk", "node")
    sent = texts.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(send(split), sharing.MESSAGE)
    replies = sharing.shared(sent, split)
    side = asked.select("chunk", "node", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("reply"))
    side = side.unionByName(replies.select("chunk", F.lit(None).cast("bigint").alias("node"), "bucket", "reply"))
    return texts.groupBy("chunk").cogroup(side.groupBy("chunk")).applyInArrow(select(split), CANDIDATE)


def linked(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Multiply out pairs (row a, pivot b, salt) of candidate rows; those at or over the threshold, with their overlaps. A pivot of many
    rows is copied to each of its salts, so that its rows do not meet in one task."""
    sets = rows.select("node", "sh")
    pivots = pairs.select("b", "salt").distinct().join(sets.select(F.col("node").alias("b"), F.col("sh").alias("sb")), "b")
    full = pairs.join(sets.select(F.col("node").alias("a"), F.col("sh").alias("sa")), "a").join(pivots, ["b", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, overlap = [], []
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = np.sort(np.concatenate([p, q]))
                o = int((both[1:] == both[:-1]).sum())
                if 100 * o >= PERCENT * (len(p) + len(q) - o):
                    keep.append(i)
                    overlap.append(o)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at), pa.array(overlap, pa.int64())], names=["a", "b", "overlap"])

    return full.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint, overlap bigint")


def pivot_pairs(rows: DataFrame) -> DataFrame:
    """Step 4: each row (a) with the pivot (b, the least node by another hash) of each of its min-hash groups, if the sizes allow a
    link; salt: the part of the pivot's rows that a is in."""
    keys = rows.select("node", "n", F.posexplode("mh").alias("j", "key"))
    groups = keys.groupBy("j", "key").agg(F.min_by(F.struct("node", "n"), F.xxhash64("node", "j")).alias("pivot"), F.count(F.lit(1)).alias("members"))
    pairs = keys.join(written(groups.where("members > 1"), "groups"), ["j", "key"]).where("node <> pivot.node")
    pairs = pairs.where(100 * F.least("n", "pivot.n") >= PERCENT * F.greatest("n", "pivot.n"))
    pairs = pairs.groupBy(F.col("node").alias("a"), F.col("pivot.node").alias("b")).agg(F.max("members").alias("members"))
    return pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("members") / SALT_ROWS)).alias("salt"))


def chains(token: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one column's rows (or runs of rows) that follow each other in size within the bound: the order by column and size,
    where runs begin in it, and the largest size up to each place of a run."""
    order = np.lexsort((hi, lo, token))
    t, low = token[order], lo[order].astype(np.int64)
    new = np.concatenate([[True], t[1:] != t[:-1]]) if len(t) else np.zeros(0, bool)
    base = np.cumsum(new) << 34
    high = np.maximum.accumulate(base + hi[order]) - base
    if len(t):
        new[1:] |= 100 * high[:-1] < PERCENT * low[1:]
    return order, np.flatnonzero(new), high


def head_edges(node: np.ndarray, order: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Each run's rows with its first, two rows of an array, each pair once."""
    head = np.repeat(node[order[start]], np.diff(np.append(start, len(order))))
    own = node[order]
    return np.unique(np.stack([head, own])[:, head != own], axis=1)


COLUMN = "bucket int, token binary, node binary, lo binary, hi binary"


def spread(n_buckets: int):
    """Prefix columns of the incidence matrix, by column block. Rows of a batch that share a column are chained on the spot and
    stand as one run (its first node, least and largest size), so a column that all rows hold sends a few entries a batch. The
    links of a chain come out under bucket -1 (token, node: their ends)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(x.as_buffer(), U) for x in batch.column("prefix")]
            length = np.array([len(p) for p in parts], np.int64)
            if not length.sum():
                continue
            token = np.concatenate(parts)
            node, n = (np.repeat(batch.column(c).to_numpy(), length) for c in ("node", "n"))
            order, start, high = chains(token, n, n)
            edges = head_edges(node, order, start)
            last = np.append(start[1:], len(order)) - 1
            cols = (token[order[start]], node[order[start]], n[order[start]].astype(np.int32), high[last].astype(np.int32))
            bucket = (cols[0] % U(n_buckets)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
            full = np.flatnonzero(at[1:] > at[:-1])
            data = [[v[by[at[b] : at[b + 1]]].tobytes() for b in full] for v in cols]
            if edges.shape[1]:
                full = np.append(full, -1)
                for d, x in zip(data, (edges[0].tobytes(), edges[1].tobytes(), None, None), strict=True):
                    d.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *(pa.array(d, pa.binary()) for d in data)], names=["bucket", "token", "node", "lo", "hi"])

    return run


def relatives(table: pa.Table) -> pa.Table:
    """One column block: runs of rows that share a column and follow each other in size within the bound, each with the first such run."""
    token, node, lo, hi = (np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(c)]) for c, t in (("token", U), ("node", np.int64), ("lo", np.int32), ("hi", np.int32)))
    order, start, _ = chains(token, lo, hi)
    a, b = head_edges(node, order, start)
    return pa.table([pa.array(a), pa.array(b)], names=["a", "b"])


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in zip(batch.column("token"), batch.column("node"), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), np.int64)) for x in (a, b)], names=["a", "b"])


def multiply(table: pa.Table) -> pa.Table:
    """Some families, or a pair of row blocks of one: overlaps of all pairs of rows of different components (in a pair of
    blocks, of rows on both sides); links that join components."""
    a, b, overlap = [], [], []
    family, node, label, n, side = (table.column(c).to_numpy() for c in ("family", "node", "label", "n", "side"))
    sets = [np.frombuffer(x.as_buffer(), U) for x in table.column("sh")]
    order = np.lexsort((node, family))
    edge = np.flatnonzero(np.concatenate([[True], family[order][1:] != family[order][:-1]]))
    for rows in np.split(order, edge[1:]):
        own = label[rows].copy()
        if (own == own[0]).all():
            continue
        size, part = n[rows], side[rows]
        lengths = np.array([len(sets[r]) for r in rows])
        _, column = np.unique(np.concatenate([sets[r] for r in rows]), return_inverse=True)
        holder = np.repeat(np.arange(len(rows)), lengths)[np.argsort(column, kind="stable")]
        count = np.bincount(column)
        start = np.cumsum(count) - count
        stop = np.cumsum(lengths)
        for i in range(1, len(rows)):
            mine = column[stop[i] - lengths[i] : stop[i]]
            many = count[mine]
            at = np.repeat(start[mine] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            total = np.bincount(holder[at], minlength=len(rows))[:i]
            good = (100 * total >= PERCENT * (size[i] + size[:i] - total)) & (own[:i] != own[i]) & ((part[:i] != part[i]) | (part[i] == 2))
            for k in np.flatnonzero(good):
                if own[k] != own[i]:
                    a.append(node[rows[k]])
                    b.append(node[rows[i]])
                    overlap.append(total[k])
                    own[own == own[k]] = own[i]
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(overlap, pa.int64())], names=["a", "b", "overlap"])


def family_links(rows: DataFrame, total: int) -> DataFrame:
    """Steps 3 to 5: links (a, b, overlap) whose components are those of all links."""
    n_blocks = chunks_for(total, BUCKET_TEXT)
    columns = written(rows.select("node", "n", "prefix").mapInArrow(spread(n_blocks), COLUMN), "columns")
    near = columns.where("bucket >= 0").groupBy("bucket").applyInArrow(relatives, "a bigint, b bigint")
    families = connected_components(near.unionByName(columns.where("bucket < 0").mapInArrow(unpacked, "a bigint, b bigint")))
    members = families.withColumnRenamed("label", "family").join(rows.select("node", "n"), "node")
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    members = written(members.join(sizes, "family"), "families")
    is_small = (F.col("rows") <= BLOCK_ROWS) & (F.col("shingles") <= BLOCK_SHINGLES)
    small = members.where(is_small).select("node", "family", F.concat(F.lit("p"), F.pmod(F.xxhash64("family"), F.lit(n_blocks))).alias("task"), F.lit(2).alias("side"), F.col("node").alias("label"))
    large = members.where(~is_small).select("node", "family", "n")
    links = None
    if large.limit(1).count():
        some = written(rows.join(large.select("node", "family"), "node"), "large")
        links = written(linked(pivot_pairs(some), some), "links")
        labels = connected_components(links)
        large = written(large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
        small = small.unionByName(block_pairs(large))
    work = rows.select("node", "n", "sh").join(small, "node")
    found = work.select("task", "family", "node", "label", "n", "side", "sh").groupBy("task").applyInArrow(multiply, "a bigint, b bigint, overlap bigint")
    return found if links is None else found.unionByName(links)


def block_pairs(large: DataFrame) -> DataFrame:
    """Rows of large families with the pairs of blocks they take part in. A component of many rows (or shingles) has blocks of its own."""
    most = {"rows": BLOCK_ROWS, "shingles": BLOCK_SHINGLES}
    of_label = large.groupBy("family", "label").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    is_alone = (F.col("rows") > most["rows"] // 2) | (F.col("shingles") > most["shingles"] // 2)
    alone, rest = of_label.where(is_alone), of_label.where(~is_alone)
    loose = rest.groupBy("family").agg(F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"))
    parts = F.greatest(*(F.ceil(F.col(c) / n) for c, n in most.items())).cast("int")
    own = large.join(alone, ["family", "label"]).withColumn("block", F.concat_ws("/", F.col("label").cast("string"), F.pmod(F.xxhash64("node"), parts).cast("string"))).withColumn("pure", F.col("label"))
    mixed = large.join(rest.select("family", "label"), ["family", "label"]).join(loose, "family").withColumn("block", F.concat_ws("/", F.lit("mixed"), F.pmod(F.xxhash64("label"), parts).cast("string"))).withColumn("pure", F.lit(None).cast("bigint"))
    dealt = written(own.select("family", "node", "label", "block", "pure").unionByName(mixed.select("family", "node", "label", "block", "pure")), "blocks")
    blocks_of = dealt.select("family", "block", "pure").distinct()
    left, right = (blocks_of.select("family", F.col("block").alias(x), F.col("pure").alias(f"{x}_pure")) for x in ("x", "y"))
    # pairs of blocks, not of rows; a component is never multiplied with itself
    pairs = left.join(right, "family").where("x <= y and (x_pure is null or y_pure is null or x_pure <> y_pure)")
    task = F.concat_ws("|", F.col("family").cast("string"), "x", "y").alias("task")
    one = pairs.select("family", task, F.col("x").alias("block"), F.when(F.col("x") == F.col("y"), 2).otherwise(0).alias("side"))
    two = pairs.where("x < y").select("family", task, F.col("y").alias("block"), F.lit(1).alias("side"))
    return dealt.join(one.unionByName(two), ["family", "block"]).select("node", "family", "task", "side", "label")


def with_components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, r, n, node, class_id, label (a name of the component, null without words) and component_id of every document."""
    n_rows, total = text_bytes(docs, text_col)
    n_chunks = chunks_for(total + 64 * n_rows, sharing.CHUNK_BYTES)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), sharing.chunk_of(n_chunks, id_col, text_col).alias("chunk"), row_hash(id_col, text_col).alias("r"))
    sets = written(fingerprints(docs), "sets")
    classes = written(sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("class_id"), F.min("chunk").alias("any_chunk"), F.min_by("chunk", "doc_id").alias("chunk")).withColumn("chunk", F.coalesce("chunk", "any_chunk")), "classes")
    rows = written(candidates(docs.select("chunk", "text"), classes, total), "candidates")
    labels = connected_components(written(family_links(rows, total), "links"))
    classes = classes.select("node", "class_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = classes.groupBy("label").agg(F.min("class_id").alias("component_id"))
    classes = classes.join(least, "label").select("node", "label", "class_id", "component_id")
    return sets.join(classes, "node", "left")


def row_hash(id_col: str, text_col: str):
    return F.xxhash64(F.lit(3), id_col, text_col)


def ngram_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, class_id (least id with the same set) and component_id (least id reachable)."""
    alone = lambda c: F.when(F.col("n") > 0, F.col(c)).otherwise(F.col("doc_id")).alias(c)
    return with_components(docs, id_col, text_col).select("doc_id", F.col("n").alias("n_shingles"), alone("class_id"), alone("component_id"))


def digest(joined: DataFrame) -> DataFrame:
    """What op10 returns."""
    return joined.select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the least id (null ids last), and all without words; their own columns."""
    found = written(with_components(docs, id_col, text_col), "components")
    first = found.where("n > 0").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "r")).alias("x")).select(F.col("x.r").alias("_kept"), F.lit(1).alias("_single"))
    kept = first.unionByName(found.where("n = 0").select(F.col("r").alias("_kept"), F.lit(0).alias("_single")).distinct())
    rows = docs.select(as_row(docs).alias("row"), row_hash(id_col, text_col).alias("r"), F.xxhash64(*hashable(docs)).alias("order"))
    joined = rows.join(kept, F.col("r") == F.col("_kept"))
    # of repeated rows (one id and text) one stays, whatever else they hold chosen by its hash, combined before anything moves
    single = joined.where("_single = 1").groupBy("r").agg(F.min_by("row", "order").alias("row"))
    return joined.where("_single = 0").select("row").unionByName(single.select("row")).select("row.*")


ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
p as (select doc_id, w, least(len(w), 5) n, unnest(range(1, greatest(len(w) - 4, 1) + 1)) p from w where len(w) > 0),
s as (select distinct doc_id, n, array_to_string(w[p:p + n - 1], ' ') k from p),
c as (select doc_id, count(*)::bigint n from s group by doc_id),
o as (select a.doc_id x, b.doc_id y, count(*) o from s a join s b on a.n = b.n and a.k = b.k and a.doc_id <> b.doc_id group by all),
l as (select x, y from o join c a on a.doc_id = x join c b on b.doc_id = y where 100 * o >= 80 * (a.n + b.n - o)),
r as (select x, y from l union select r.x, l.y from r join l on r.y = l.x)
select w.doc_id, coalesce(c.n, 0)::bigint n_shingles, least(w.doc_id, coalesce(m.y, w.doc_id)) component_id
from w left join c using (doc_id) left join (select x doc_id, min(y) y from r group by x) m using (doc_id)
"""
