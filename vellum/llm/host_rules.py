"""Host-level quality rules: per-document rule failures, shrunken failure rates of each host, verdicts joined back.

Every whole text is measured once (``measure``; Arrow batches in, a few numbers out). Failures are then counted by host,
each host's rate for each rule is shrunk towards an empirical beta prior fitted to all hosts by moments, and a host
is rejected when a shrunken rate passes the rule's limit. The verdict is joined back to the documents.

Hosts are compared null-safely: documents without a host form a host of their own. Words are runs of characters other than
space and U+0009-U+000D; lines are cut at newlines. Null and empty texts have no words and fail the length rule. Repeated
rows count and are judged one by one. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.tables import written
from vellum.llm.textblock import NOT_SPACE, Block, U, blocks, cut, mix, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_word_lines")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: rule -> the shrunken rate of failures from which a host is rejected
LIMITS = {"short": 0.5, "repeats": 0.5, "symbols": 0.5, "word_length": 0.5, "dup_lines": 0.5}


def rules(c=F.col) -> dict[str, Column]:
    """The failures of one document, from its measures."""
    return {
        "short": c("n_words") < 50,
        "repeats": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbols": 10 * c("n_symbols") > c("n_words"),
        "word_length": (c("n_words") > 0) & ((c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words"))),
        "dup_lines": 10 * c("n_dup_lines") > 3 * c("n_word_lines"),
    }


def measures(block: Block) -> dict[str, np.ndarray]:
    """MEASURES of each text of a block."""
    n = block.n
    st, en, first, hashes = words(block, NOT_SPACE, lower=False)
    n_words = np.diff(first)
    own = np.repeat(np.arange(n), n_words)

    def running(mask: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(mask)])

    dense = NOT_SPACE[block.buf]
    chars, solid, symbols = running(dense & ((block.buf & 0xC0) != 0x80)), running(dense), running(SYMBOLS[block.buf])
    lst, len_, lfirst = block.lines()
    line_of = np.repeat(np.arange(n), np.diff(lfirst))
    full = solid[len_] > solid[lst]
    key = mix(cut(block.prefix(), lst, len_)[full] + line_of[full].astype(U) * U(0x9E3779B97F4A7C15))
    kept, at = np.unique(key, return_index=True)
    word_lines = np.bincount(line_of[full], minlength=n)
    out = {
        "n_words": n_words, "word_chars": chars[block.offs[1:]] - chars[block.offs[:-1]],
        "n_symbols": symbols[block.offs[1:]] - symbols[block.offs[:-1]],
        "n_dup_lines": word_lines - np.bincount(line_of[full][at], minlength=n), "n_word_lines": word_lines,
    }
    repeat = np.zeros(len(hashes) + 2, bool)
    if len(hashes) > 2:
        windows = mix(mix(hashes[:-2] * U(3) + hashes[1:-1]) * U(5) + hashes[2:] + own[:-2].astype(U) * U(0x9E3779B97F4A7C15))
        p = np.flatnonzero(own[:-2] == own[2:])
        order = p[np.argsort(windows[p])]
        same = windows[order][1:] == windows[order][:-1]
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        for j in range(3):
            repeat[order[twice[: len(order)]] + j] = True
    out["n_repeat_words"] = np.bincount(own, weights=repeat[: len(own)], minlength=n)
    return {k: v.astype(np.int64) for k, v in out.items()}


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without their texts, with MEASURES added."""
    rest = [c for c in docs.columns if c != text_col]
    schema = docs.select(*rest, *(F.lit(0).cast("long").alias(f"m_{m}") for m in MEASURES)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measures(b) for b in blocks(batch.column(text_col))]
            new = [np.concatenate([p[m] for p in parts]) if parts else np.zeros(0, np.int64) for m in MEASURES]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *map(pa.array, new)], names=schema.names)

    return docs.select(*rest, text_col).mapInArrow(run, schema)


def host_verdicts(failures: DataFrame, host: str, names: list[str], limits: dict[str, float] = LIMITS) -> DataFrame:
    """failures: a row a document, its host and a boolean for each name. One row a host: n, the shrunken rates, host_kept."""
    counts = failures.groupBy(host).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.coalesce(F.col(r), F.lit(False)).cast("int")).alias(r) for r in names))
    prior = counts.agg(*(x for r in names for x in (F.avg(F.col(r) / F.col("n")).alias(f"mean_{r}"), F.var_pop(F.col(r) / F.col("n")).alias(f"var_{r}"))))
    shrunk = counts.crossJoin(F.broadcast(prior))  # the prior is one row
    for r in names:
        m, v = F.col(f"mean_{r}"), F.col(f"var_{r}")
        # beta(a, b) with the hosts' mean and variance; a prior as strong as 1 to 1000 documents
        strength = F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.when(v > 0, m * (1 - m) / v - 1).otherwise(F.lit(1000.0))))
        shrunk = shrunk.withColumn(f"rate_{r}", (F.col(r) + m * strength) / (F.col("n") + strength))
    good = F.lit(True)
    for r in names:
        good = good & (F.col(f"rate_{r}") <= limits[r])
    return shrunk.select(host, "n", *(f"rate_{r}" for r in names), good.alias("host_kept"))


def host_rules(docs: DataFrame, *, id_col: str = "doc_id", host: str = "source", text_col: str = "text") -> DataFrame:
    """One row a document: id, host, measures (m_*), failures (fails_*), its host's rates and host_kept; other columns are left out."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(host).alias("host"), F.col(text_col).alias("text"))
    m = lambda c: F.col(f"m_{c}")
    measured = measure(docs).select("*", *(e.alias(f"fails_{r}") for r, e in rules(m).items()))
    measured = written(measured, "measures")
    names = list(rules(m))
    verdicts = host_verdicts(measured.select(F.col("host").alias("host_key"), *(F.col(f"fails_{r}").alias(r) for r in names)), "host_key", names)
    return measured.join(verdicts.withColumnRenamed("n", "host_n"), measured["host"].eqNullSafe(verdicts["host_key"]), "left").drop("host_key")


def digest(judged: DataFrame) -> DataFrame:
    """What op6 returns."""
    base = F.col("fails_short") | F.col("fails_repeats")
    return judged.select(
        "doc_id", *(F.col(f"m_{m}").alias(m) for m in MEASURES[:5]),
        base.alias("base_failed"), (~base & F.col("host_kept")).alias("kept"),
    )


ORACLE = r"""
with d as (select row_number() over () rid, doc_id, source, coalesce(text, '') t from documents),
w as (select rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws, t from d),
tri as (select rid, unnest(range(1, greatest(len(ws) - 1, 1))) p, ws from w where len(ws) >= 3),
tk as (select rid, p, ws[p] || chr(10) || ws[p + 1] || chr(10) || ws[p + 2] k from tri),
rep as (select rid, p from (select rid, p, count(*) over (partition by rid, k) c from tk) where c > 1),
hit as (select rid, count(distinct p + j) n from rep, (values (0), (1), (2)) v(j) group by rid),
ln as (select rid, unnest(string_split(t, chr(10))) l from d),
wl as (select rid, count(*) n, count(distinct l) u from ln where regexp_matches(l, '[^\x20\x09-\x0D]') group by rid),
m as (select d.rid, d.doc_id, d.source, len(ws)::bigint n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint word_chars,
        length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, coalesce(wl.n - wl.u, 0)::bigint n_dup_lines,
        coalesce(hit.n, 0)::bigint n_repeat_words, coalesce(wl.n, 0)::bigint n_word_lines
      from d join w using (rid) left join hit using (rid) left join wl using (rid)),
f as (select *, (n_words < 50)::int short, (100 * n_repeat_words > 50 * n_words)::int repeats, (10 * n_symbols > n_words)::int symbols,
        (n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words))::int word_length, (10 * n_dup_lines > 3 * n_word_lines)::int dup_lines from m),
h as (select source, rule, count(*) n, sum(x) k from f, lateral (values ('short', short), ('repeats', repeats), ('symbols', symbols), ('word_length', word_length), ('dup_lines', dup_lines)) v(rule, x) group by source, rule),
pr as (select rule, avg(k / n) mu, var_pop(k / n) va from h group by rule),
bad as (select distinct source from (select source, (k + mu * s) / (n + s) rate from (
          select *, least(1000.0, greatest(1.0, case when va > 0 then mu * (1 - mu) / va - 1 else 1000.0 end)) s from h join pr using (rule))) where rate > 0.5)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (short + repeats > 0) base_failed,
  (short + repeats = 0 and not exists (select 1 from bad b where b.source is not distinct from f.source)) kept
from f
"""
