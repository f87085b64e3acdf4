"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are shares of byte classes, word shapes and repetition, taken from the line itself
and from both neighbours; two labels and their transitions form the chain. The field is fitted on documents whose label all
their lines inherit, by gradient steps on the exact conditional likelihood (forward-backward). A document's quality
is the length-weighted mean of its lines' forward-backward marginals, put on the scale of the labels by a two-parameter
logistic map fitted on the same documents.

Fitting is the one step that uses a bounded sample: at most ``SAMPLE`` labelled documents (the first in a hash order), fewer once
they have ``SAMPLE_TOTAL_LINES`` lines together; each is read whole. Scoring covers all whole texts, long ones in pieces of whole
lines (a single line is one value), of which some 100 bytes a line are held. Labels, language, source and id are no inputs of a score.
Null and empty texts have one empty line and so a score like any other. Documents labelled both ways count as bad (label
mean below 1); null labels are skipped; with no labels, or labels of one kind only, every score is the share of good labels (0.5
without labels). Repeated rows are scored alike; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.tables import free
from vellum.llm.textblock import LOWER, NOT_SPACE, Block, blocks, cut, words

SAMPLE, SAMPLE_TOTAL_LINES = 3000, 600_000
#: features are built for so much text at a time; chains of more lines advance by stretches
PIECE_BYTES, LONG_CHAIN = 256 << 10, 4096


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


UPPER = _class(bytes(range(65, 91)))
CLASSES = [UPPER, _class(bytes(range(97, 123))), _class(bytes(range(48, 58))), _class(b".,;:?"), _class(b"!"), _class(b"|<>"), _class(b"#*$%&@"), _class(b"()[]{}=/\\_~^+-\"'"), np.arange(256) >= 128]
SELF = len(CLASSES) + 8
WIDTH = 3 * SELF + 1


def own_features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line of a block on its own (the repetition of lines left 0), the lines' lengths in bytes, each text's
    first line, and the lines' hashes (0 for lines without words)."""
    st, en, first = block.lines()
    n = len(st)
    size = (en - st).astype(np.float64)
    wst, wen, _, hashes = words(block, NOT_SPACE, lower=True)
    line = np.searchsorted(st, wst, "right") - 1 if len(wst) else np.zeros(0, np.int64)
    count = np.bincount(line, minlength=n).astype(np.float64)
    solid = np.bincount(line, weights=(wen - wst).astype(np.float64), minlength=n)
    out = np.zeros((n, SELF))
    for k, c in enumerate(CLASSES):
        run = np.concatenate([[0], np.cumsum(c[block.buf])])
        out[:, k] = (run[en] - run[st]) / np.maximum(solid, 1)
    k = len(CLASSES)
    same_line = line[1:] == line[:-1]
    again = np.zeros(len(line))
    again[1:] = same_line & (hashes[1:] == hashes[:-1])
    seen = np.zeros(len(line))
    if len(line):
        order = np.lexsort((hashes, line))
        seen[order[1:]] = (hashes[order][1:] == hashes[order][:-1]) & (line[order][1:] == line[order][:-1])
    out[:, k] = np.bincount(line, weights=again, minlength=n) / np.maximum(count, 1)
    out[:, k + 1] = np.bincount(line, weights=seen, minlength=n) / np.maximum(count, 1) * np.minimum(1, count / 20)
    out[:, k + 2] = np.minimum(solid / np.maximum(count, 1), 30) / 10
    out[:, k + 3] = np.log1p(count) / 5
    out[:, k + 4] = count == 0
    out[:, k + 5] = np.bincount(line, weights=(wen - wst > 20).astype(np.float64), minlength=n) / np.maximum(count, 1)
    # words that end in a symbol or mark
    last = block.buf[wen - 1] if len(wen) else np.zeros(0, np.uint8)
    out[:, k + 6] = np.bincount(line, weights=(CLASSES[6] | CLASSES[4])[last].astype(np.float64), minlength=n) / np.maximum(count, 1)
    key = cut(block.prefix(LOWER[block.buf]), st, en)
    key[count == 0] = 0
    return out, size, first, key


def repeats(key: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Lines with words that equal an earlier one of their text."""
    order = np.lexsort((key, own))
    dup = np.zeros(len(key), bool)
    dup[order[1:]] = (key[order][1:] == key[order][:-1]) & (own[order][1:] == own[order][:-1])
    return dup & (key != 0)


def line_features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All features of each line of a block (its own, those of both neighbours, a constant), the lines' lengths, each text's first line."""
    out, size, first, key = own_features(block)
    n = len(size)
    own = np.repeat(np.arange(block.n), np.diff(first))
    out[:, SELF - 1] = repeats(key, own)
    full = np.ones((n, WIDTH))
    full[:, :SELF] = out
    before, after = np.zeros_like(out), np.zeros_like(out)
    inner = own[1:] == own[:-1]
    before[1:][inner] = out[:-1][inner]
    after[:-1][inner] = out[1:][inner]
    full[:, SELF : 2 * SELF], full[:, 2 * SELF : 3 * SELF] = before, after
    return full, size, first


def line_pieces(block: Block) -> Iterator[Block]:
    """A block of one text in pieces of whole lines of about ``PIECE_BYTES`` (a longer line is one piece); others as they are."""
    if block.n != 1 or len(block.buf) <= PIECE_BYTES:
        yield block
        return
    nl, at, n = np.flatnonzero(block.buf == 10), 0, len(block.buf)
    while True:
        k = int(np.searchsorted(nl, at + PIECE_BYTES, "right")) - 1
        if k < 0 or nl[k] < at:
            k += 1
        end = int(nl[k]) if k < len(nl) else n
        yield Block(block.first, block.buf[at:end], np.array([0, end - at]))
        if k >= len(nl):
            return
        at = end + 1


def emissions(field: "Field", block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each line's score for the good label, the lines' lengths, each text's first line. A long text is taken in pieces, of which a
    score, a length and a hash a line stay."""
    parts: list[list[np.ndarray]] = [[], [], [], []]
    w = field.weights[: 3 * SELF].reshape(3, SELF)
    for piece in line_pieces(block):
        out, size, first, key = own_features(piece)
        for x, v in zip(parts, (out @ w.T, size, key, first), strict=True):
            x.append(v)
    score, size, key = (np.concatenate(x) for x in parts[:3])
    first = parts[3][0] if len(parts[3]) == 1 else np.array([0, len(size)])
    own = np.repeat(np.arange(block.n), np.diff(first))
    score += repeats(key, own)[:, None] * w[:, SELF - 1]
    inner = own[1:] == own[:-1]
    total = score[:, 0] + field.weights[-1]
    total[1:][inner] += score[:-1, 1][inner]
    total[:-1][inner] += score[1:, 2][inner]
    return total, size, first


@dataclass
class Field:
    """weights of the features for the good label, transition scores between labels (0 bad, 1 good), the map to scores."""

    weights: np.ndarray
    trans: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)
    constant: float | None = None


def marginals(field: Field, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all texts at once, the longest first: each line's chance to be good, and expected transitions."""
    return chains(x @ field.weights, field.trans, first)


def chains(score: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same from each line's score for the good label."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    start, length = first[:-1][order], length[order]
    e, m = exponentials(score), np.exp(trans - trans.max())
    alpha, beta = np.empty_like(e), np.ones_like(e)
    steps = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(steps), "left")  # texts with more than t lines
    for t in range(steps):
        k = alive[t]
        at = start[:k] + t
        a = e[at] if t == 0 else e[at] * (alpha[at - 1] @ m)
        alpha[at] = a / a.sum(1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        k = alive[t + 1]
        at = start[:k] + t
        right = e[at + 1] * beta[at + 1]
        joint = alpha[at][:, :, None] * m[None] * right[:, None, :]
        total = joint.sum((1, 2), keepdims=True)
        pairs += (joint / total).sum(0)
        b = right @ m.T
        beta[at] = b / b.sum(1, keepdims=True)
    p = alpha * beta
    return p[:, 1] / p.sum(1), pairs


def exponentials(score: np.ndarray) -> np.ndarray:
    emit = np.zeros((len(score), 2))
    emit[:, 1] = score
    return np.exp(emit - emit.max(1, keepdims=True))


def forward(e: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Forward messages of one long chain, each scaled to sum 1. The chain is cut in stretches that advance side by side: first
    their transfer matrices, then the messages at their ends, then those within."""
    n = len(e)
    wide = int(np.ceil(np.sqrt(n)))
    rows = -(-n // wide)
    padded = np.ones((rows * wide, 2))
    padded[:n] = e
    steps = padded.reshape(rows, wide, 2)
    move = np.tile(np.eye(2), (rows, 1, 1))
    for t in range(wide):
        move = move @ m * steps[:, t, None, :]
        move /= move.sum((1, 2), keepdims=True)
    entry = np.empty((rows, 2))
    # the first line has no transition before it: its stretch is advanced on its own
    lead = e[0] / e[0].sum()
    first = lead
    for t in range(1, min(wide, n)):
        first = first @ m * e[t]
        first = first / first.sum()
    entry[0], now = np.nan, first
    for r in range(1, rows):
        entry[r] = now
        now = now @ move[r]
        now = now / now.sum()
    out = np.empty((rows, wide, 2))
    now = entry.copy()
    for t in range(wide):
        now = now @ m * steps[:, t]
        if t == 0:
            now[0] = lead
        now /= now.sum(1, keepdims=True)
        out[:, t] = now
    return out.reshape(-1, 2)[:n]


def good_lines(field: Field, score: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's chance to be good; a chain of many lines by stretches."""
    if len(first) != 2 or len(score) <= LONG_CHAIN:
        return chains(score, field.trans, first)[0]
    e, m = exponentials(score), np.exp(field.trans - field.trans.max())
    p = forward(e, m) * forward(e[::-1], m.T)[::-1] / e
    return p[:, 1] / p.sum(1)


def quality(field: Field, p: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each text's length-weighted mean of its lines' chances. An empty line weighs one byte."""
    w = size + 1
    return np.add.reduceat(p * w, first[:-1]) / np.add.reduceat(w, first[:-1]) if len(first) > 1 else np.zeros(0)


def scores(field: Field, q: np.ndarray) -> np.ndarray:
    if field.constant is not None:
        return np.full(len(q), field.constant)
    z = np.clip(q, 1e-6, 1 - 1e-6)
    return 1 / (1 + np.exp(-(field.scale[0] * np.log(z / (1 - z)) + field.scale[1])))


def fit(x: np.ndarray, size: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 150, ridge: float = 1e-3) -> Field:
    """Adam on the mean conditional log-likelihood per line, documents of both labels weighing alike in number."""
    if len(set(label.tolist())) < 2:
        return Field(np.zeros(WIDTH), np.zeros((2, 2)), constant=float(label.mean()) if len(label) else 0.5)
    y = np.repeat(label, np.diff(first)).astype(np.float64)
    field = Field(np.zeros(WIDTH), np.zeros((2, 2)))
    seen = np.zeros((2, 2))
    for c in (0, 1):
        seen[c, c] = (np.diff(first)[label == c] - 1).sum()
    theta, m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for r in range(1, rounds + 1):
        field.weights, field.trans = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
        p, pairs = marginals(field, x, first)
        g = np.concatenate([x.T @ (y - p), (seen - pairs).ravel()]) / len(x) - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.15 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    field.weights, field.trans = theta[:WIDTH].copy(), theta[WIDTH:].reshape(2, 2).copy()
    z = np.clip(quality(field, marginals(field, x, first)[0], size, first), 1e-6, 1 - 1e-6)
    z = np.log(z / (1 - z))
    a, b = 1.0, 0.0
    w = np.where(label == 1, 0.5 / (label == 1).sum(), 0.5 / (label == 0).sum())
    for _ in range(50):  # Newton on two parameters, lightly held to the identity
        p = 1 / (1 + np.exp(-(a * z + b)))
        h = w * p * (1 - p)
        grad = np.array([(w * (label - p) * z).sum() - 1e-3 * (a - 1), (w * (label - p)).sum() - 1e-3 * b])
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
    field.scale = (max(a, 0.05), b)
    return field


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Field:
    """docs: the documents that labels may be learnt from; labels: id and label (0 or 1)."""
    # two columns of each side, under names of our own: the others may have any names
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y")).where("i is not null and y is not null").groupBy("i").agg(F.floor(F.avg("y")).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("i"), "i").limit(sample)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    id_type = own.schema["id"].dataType.simpleString()
    # the sample is bounded, so it may be broadcast; of a repeated id the text with the least hash counts
    rows = own.join(F.broadcast(known), F.col("id") == F.col("i")).groupBy("id").agg(F.min_by(F.struct("y", "t"), F.xxhash64("t")).alias("x")).select(F.col("id").alias("_id"), F.col("x.y").alias("_y"), F.col("x.t").alias("t"))
    # whole documents in hash order, up to the one with which the lines are enough
    n = F.coalesce(F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit(""))), F.lit(0)) + 1
    sizes = rows.select("_id", n.alias("n")).orderBy(F.xxhash64("_id"), "_id").collect()
    before = np.cumsum([0, *(r["n"] for r in sizes)])[:-1]
    if len(sizes) and before[-1] >= SAMPLE_TOTAL_LINES:
        chosen = [(r["_id"],) for r, k in zip(sizes, before, strict=True) if k < SAMPLE_TOTAL_LINES]
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, f"_id {id_type}")), "_id").select("_id", "_y", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # features go out block by block, so none wait for a whole batch
            for block in blocks(batch.column("t"), PIECE_BYTES):
                x, size, first = line_features(block)
                x = x.astype(np.float32)
                spans = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
                part = batch.slice(block.first, block.n)
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_y"), pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([size[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([b - a for a, b in spans], pa.int32())], names=["_id", "_y", "x", "s", "n"])

    got = {r["_id"]: r for r in rows.mapInArrow(run, f"_id {id_type}, _y int, x binary, s binary, n int").toLocalIterator()}
    got = [got[k] for k in sorted(got)]
    if not got:
        return Field(np.zeros(WIDTH), np.zeros((2, 2)), constant=0.5)
    x = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in got]).astype(np.float64)
    size = np.concatenate([np.frombuffer(r["s"], np.float64) for r in got])
    return fit(x, size, np.concatenate([[0], np.cumsum([r["n"] for r in got])]), np.array([r["_y"] for r in got]))


def score(docs: DataFrame, field: Field, *, text_col: str = "text", out: str = "score", keep_text: bool = False) -> DataFrame:
    """The documents' columns (the text only if asked for) with their scores, 0 to 1."""
    rest = [c for c in docs.columns if keep_text or c != text_col]
    schema = docs.select(*rest, F.lit(0.0).alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = []
            for block in blocks(batch.column(text_col), PIECE_BYTES):
                line, size, first = emissions(field, block)
                q.append(scores(field, quality(field, good_lines(field, line, first), size, first)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(np.concatenate(q) if q else np.zeros(0))], names=schema.names)

    return docs.select(*rest, *([] if keep_text else [text_col])).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What op1 returns: learnt from labels of documents that are not held out."""
    field = train(docs.where(~held_out()), labels.where(~held_out()))
    scored = score(docs.select("doc_id", "text"), field)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", least: float = 0.5, **options) -> DataFrame:
    """The documents whose score is at least ``least``, with their own columns."""
    field = train(docs, labels, text_col=text_col, **options)
    name = free("_score", docs.columns)
    return score(docs, field, text_col=text_col, out=name, keep_text=True).where(F.col(name) >= least).select(*docs.columns)
