"""Every operator against a brute-force version, with null, empty, long, tied and repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import os
import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from cases import components, contamination, documents, frame, lines, measures, rows_of, suffix_dedup, untouched
from pyspark.sql import functions as F

from vellum.llm import chat_format, decontaminate, host_rules, html_layout, induced_sort, line_dedup, mixing, ngram_join, quality, sharding
from vellum.llm import suffix_dedup as suffixes
from vellum.llm.components import connected_components
from vellum.llm.tables import written


@pytest.fixture(scope="module", autouse=True)
def small_parts():
    """Chunks, buckets and shards small enough that the small tables have several."""
    patch = pytest.MonkeyPatch()
    for module, name, value in ((suffixes, "CHUNK_TEXT", 9000), (suffixes, "BUCKET_TEXT", 20000), (suffixes, "SHARD_TEXT", 20000), (ngram_join, "BUCKET_TEXT", 20000), (ngram_join.sharing, "CHUNK_BYTES", 9000)):
        patch.setattr(module, name, value)
    yield
    patch.undo()


ROWS = documents()
EMPTY: list[tuple] = []


@pytest.mark.parametrize("rows", [ROWS, EMPTY, [(1, None, None, None)]], ids=["all", "empty", "null"])
def test_ngram_join(spark, rows):
    assert rows_of(ngram_join.digest(ngram_join.ngram_join(frame(spark, rows)))) == components(rows)


def test_ngram_join_large_families(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 4)
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(90)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "a"))
    assert rows_of(ngram_join.digest(ngram_join.ngram_join(frame(spark, rows)))) == components(rows)


def test_hot_columns_send_a_few_entries(spark):
    r = np.random.default_rng(1)
    prefix = [np.append(r.integers(1, 1 << 62, 3), 7).astype(np.uint64) for _ in range(4000)]
    rows = spark.createDataFrame([(i, 100 + i % 10, bytearray(p.tobytes())) for i, p in enumerate(prefix)], "node bigint, n bigint, prefix binary")
    out = rows.repartition(4).mapInArrow(ngram_join.spread(3), ngram_join.COLUMN).collect()
    hot = sum((np.frombuffer(x["token"], np.uint64) == 7).sum() for x in out if x["bucket"] >= 0)
    assert 1 <= hot <= 8  # one run a batch
    ends = {int(v) for x in out if x["bucket"] < 0 for v in np.frombuffer(x["node"], np.int64)}
    assert len(ends) >= 4000 - 8


def test_keep_one(spark):
    df = frame(spark, ROWS)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and untouched(kept.collect())
    want = components(ROWS)
    texts = {x[0]: x[1] for x in kept.collect() if x[0] is not None}
    groups = {c for i, n, c in want if n and c is not None}
    assert {i for i in texts if (texts[i] or "").split()} == groups
    assert kept.where("trim(translate(coalesce(text, ''), '\t\n', '  ')) = ''").count() == sum(not (x[1] or "").split() for x in ROWS)
    assert ngram_join.keep_one(frame(spark, EMPTY)).count() == 0


ITEMS = [(1, " ".join((ROWS[5][1] or "a b").split()[:30])), (2, "one two"), (None, None), (4, ""), (5, ROWS[10][1]), (5, ROWS[10][1]), (6, "漢字 über"), (7, "aaaa")]


@pytest.mark.parametrize("piece", [1 << 20, 60], ids=["whole", "pieces"])
@pytest.mark.parametrize("rows,items", [(ROWS, ITEMS), (EMPTY, ITEMS), (ROWS, EMPTY)], ids=["all", "no documents", "no items"])
def test_decontaminate(spark, rows, items, piece):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.digest(decontaminate.find_contamination(frame(spark, rows).select("doc_id", "text"), bench, piece_bytes=piece))
    assert rows_of(found) == contamination(rows, items)
    if rows and items:
        df = frame(spark, rows)
        kept = decontaminate.decontaminate(df, bench, piece_bytes=piece)
        assert kept.columns == df.columns and untouched(kept.collect())
        assert sorted(map(repr, (x[:2] for x in kept.collect()))) == sorted(repr((x[0], x[1])) for x in rows if not contamination([x], items)[0][5])


def test_longest_match(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "zz " + " ".join(f"w{i}" for i in range(5, 30)) + " yy")], "doc_id bigint, text string")
    found = decontaminate.find_contamination(docs, spark.createDataFrame([(9, text)], "item_id bigint, text string")).first()
    assert [tuple(m) for m in found["matches"]] == [("9", 1, 5, 25)]


def test_contamination_is_linear_in_repetitions(spark):
    docs = spark.createDataFrame([(1, "aaa " * 20_000), (2, " ".join(f"w{i}" for i in range(300)))], "doc_id bigint, text string")
    items = [(i, " ".join(f"w{j}" for j in range(300))) for i in range(3000)] + [(5000, "aaa " * 10_000)]
    began = time.time()
    got = {x["doc_id"]: x for x in decontaminate.find_contamination(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert time.time() - began < 20
    assert got[1]["n_hit"] == 20_000 and got[1]["items"] == ["5000"] and len(got[1]["matches"]) <= 2001
    assert got[2]["items"] == sorted(str(i) for i in range(3000)) and {tuple(m)[1:] for m in got[2]["matches"]} == {(0, 0, 300)} and len(got[2]["matches"]) < 20


def test_benchmark_comes_in_bounded_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECES", 2)
    passes = []
    monkeypatch.setattr(decontaminate, "written", lambda df, what: passes.append(what) or written(df, what))
    docs = spark.createDataFrame([(i, f"alpha beta gamma item number {i} of many here") for i in range(20)], "doc_id bigint, text string")
    items = [(i, f"item number {i} of many") for i in range(40)]
    got = decontaminate.find_contamination(docs, spark.createDataFrame(items, "item_id bigint, text string"), piece_bytes=200).collect()
    assert all(x["items"] == [str(x["doc_id"])] and x["n_hit"] == 5 for x in got) and len(passes) >= 2


@pytest.mark.parametrize("rows", [ROWS, EMPTY], ids=["all", "empty"])
def test_suffix_dedup(spark, rows):
    assert rows_of(suffixes.digest(suffixes.suffix_dedup(frame(spark, rows)))) == suffix_dedup(rows)


def test_suffix_dedup_long_texts_in_pieces(spark):
    r = random.Random(8)
    text = " ".join(f"w{r.getrandbits(40)}" for _ in range(190_000))
    assert len(text) > 2.2 * (1 << 20)
    at = (1 << 20) - 30
    rows = [(1, text[at : at + 200], "en", "a"), (2, text, "en", "a"), (3, "q" + text[-400:], "en", "a"), (4, "é" + text[100:160], "en", "a")]
    got = {x["doc_id"]: x for x in suffixes.suffix_dedup(frame(spark, rows)).collect()}
    assert [tuple(x) for x in got[2]["spans"]] == [(at, 200)] and [tuple(x) for x in got[3]["spans"]] == [(1, 400)] and [tuple(x) for x in got[4]["spans"]] == [(2, 60)]
    assert got[1]["n_removed"] == 0


@pytest.mark.parametrize("operator", ["ngram", "suffix"])
def test_messages_in_two_steps(spark, monkeypatch, operator):
    monkeypatch.setattr(suffixes.sharing, "ONE_LEVEL", 2)
    monkeypatch.setattr(suffixes, "CHUNK_TEXT", 3000)
    monkeypatch.setattr(suffixes, "BUCKET_TEXT", 6000)
    monkeypatch.setattr(ngram_join, "BUCKET_TEXT", 6000)
    monkeypatch.setattr(ngram_join.sharing, "CHUNK_BYTES", 3000)
    assert suffixes.sharing.split(300_000, 6000) == (50, 8)
    if operator == "ngram":
        assert rows_of(ngram_join.digest(ngram_join.ngram_join(frame(spark, ROWS)))) == components(ROWS)
    else:
        assert rows_of(suffixes.digest(suffixes.suffix_dedup(frame(spark, ROWS)))) == suffix_dedup(ROWS)


def test_hot_pieces_do_not_make_large_shards(spark, monkeypatch):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(8))
    shared = " ".join(word() for _ in range(30))
    # one piece of 12 bytes every 40 bytes of all rows, with other bytes around it
    rows = [(i, "".join(f"{word()}{word()}{word()}THE HOT ONE!" for _ in range(60)) + (shared if i % 2 else ""), "en", "a") for i in range(60)]
    piece = suffixes.Block(0, np.frombuffer(b"THE HOT ONE!", np.uint8), np.array([0, 12])).prefix()
    key = (piece[12:] - piece[:-12]) * suffixes.power("down", 1)
    monkeypatch.setattr(suffixes, "SAMPLE_EVERY", 2)
    monkeypatch.setattr(suffixes, "HOT_SHARDS", 0.2)
    texts = frame(spark, rows).select("doc_id", "text", (F.col("doc_id") % 20).cast("int").alias("chunk"))
    hot = suffixes.hot_pieces(texts, 50, 20, sum(len(x[1]) for x in rows))
    text = np.frombuffer(rows[0][1].encode(), np.uint8)
    prefix = suffixes.Block(0, text, np.array([0, len(text)])).prefix()
    share = lambda h: np.unique(suffixes.least_piece(prefix, 12, 50, h), return_counts=True)[1].max() / (len(text) - 49)
    forced = np.sort(np.append(hot, key).astype(np.uint64))
    assert share(forced) < 0.05 and len(hot) <= suffixes.MOST_HOT
    # whichever pieces are hot, the same bytes go
    assert rows_of(suffixes.digest(suffixes.suffix_dedup(frame(spark, rows)))) == suffix_dedup(rows)
    monkeypatch.setattr(suffixes, "hot_pieces", lambda *a: forced)
    assert rows_of(suffixes.digest(suffixes.suffix_dedup(frame(spark, rows)))) == suffix_dedup(rows)


def test_suffix_array_sorts(monkeypatch):
    r = np.random.default_rng(0)
    for trial in range(200):
        monkeypatch.setattr(induced_sort, "WIDE", 4 if trial % 2 else 20_000)
        s = np.append(r.integers(1, r.integers(2, 6), r.integers(1, 80)), 0)
        t = bytes(s.tolist())
        assert induced_sort.suffix_array(s, int(s.max()) + 1).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_permuted_prefixes():
    r = np.random.default_rng(3)
    for trial in range(60):
        raw = np.append(r.integers(1, r.integers(2, 5), r.integers(1, 300)), 254).astype(np.uint8)
        if trial % 3 == 0:
            raw[: len(raw) - 1] = np.resize(raw[:7], len(raw) - 1)
        s = raw.astype(np.int64)
        s[-1] = 0
        sa = induced_sort.suffix_array(s, 260)
        got, t = induced_sort.permuted_prefixes(raw, sa), raw.tobytes()
        for x, y in zip(sa[:-1].tolist(), sa[1:].tolist()):
            n = 0
            while y + n < len(t) and x + n < len(t) and t[x + n] == t[y + n]:
                n += 1
            assert got[y] == n


def test_line_store_has_buckets_for_its_keys(spark, tmp_path):
    store = line_dedup.LineStore(spark, f"file://{tmp_path}/store", buckets=2, bucket_keys=10)
    rows = [(i, f"this is line number {i}\nand another one {i}", "en", "a") for i in range(50)]
    assert rows_of(line_dedup.digest(line_dedup.line_dedup(frame(spark, rows), batches=1, store=store))) == lines(rows)
    assert [x[2] for x in store.runs] == [16]
    again = line_dedup.LineStore(spark, f"file://{tmp_path}/store", buckets=2, bucket_keys=10)
    more = [(100 + i, f"this is line number {i}\nshort", "en", "a") for i in range(3)]
    assert rows_of(line_dedup.digest(line_dedup.line_dedup(frame(spark, more), batches=1, store=again))) == [x for x in lines(rows + more) if x[0] >= 100]
    store.close()
    again.close()


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_line_dedup(spark, batches):
    df = frame(spark, ROWS)
    assert rows_of(line_dedup.digest(line_dedup.line_dedup(df, batches=batches))) == lines(ROWS)


def test_line_dedup_empty_and_reopened_store(spark, tmp_path):
    assert line_dedup.line_dedup(frame(spark, EMPTY)).count() == 0
    path = f"file://{tmp_path}/store"
    rows = [x for x in ROWS if x[0] is not None]
    low, high = [x for x in rows if x[0] < 40], [x for x in rows if x[0] >= 40]
    first = line_dedup.digest(line_dedup.line_dedup(frame(spark, low), batches=3, store=line_dedup.LineStore(spark, path)))
    store = line_dedup.LineStore(spark, path)
    assert store.runs and all(len([x for x in store.runs if x[0] == k]) < store.fan_out for k in range(5))
    second = line_dedup.digest(line_dedup.line_dedup(frame(spark, high), batches=1, store=store))
    assert sorted(rows_of(first) + rows_of(second), key=repr) == lines(rows)
    store.close()


@pytest.mark.parametrize("rows", [ROWS, EMPTY], ids=["all", "empty"])
def test_host_rules(spark, rows):
    got = host_rules.digest(host_rules.host_rules(frame(spark, rows))).collect()
    want = sorted(((x[0], *measures(x[1])) for x in rows), key=repr)
    assert sorted(((tuple(x)[:6]) for x in got), key=repr) == want
    for x in got:
        assert x["base_failed"] == (x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"])
        assert not (x["base_failed"] and x["kept"])


def test_host_verdicts_shrink(spark):
    rows = [("good", False)] * 200 + [("bad", True)] * 90 + [("bad", False)] * 10 + [("tiny", True)] + [(None, False)] * 50
    got = {x["host"]: x for x in host_rules.host_verdicts(spark.createDataFrame(rows, "host string, r boolean"), "host", ["r"], {"r": 0.5}).collect()}
    assert not got["bad"]["host_kept"] and got["good"]["host_kept"] and got[None]["host_kept"]
    assert got["tiny"]["rate_r"] < 1 and got["good"]["rate_r"] > 0


def waterfill(sizes: list[float], weights: list[float], cap: float = 3) -> list[float]:
    """Share by weight, stop at the cap, reshare the excess until none is above."""
    total, full = sum(sizes), set()
    while True:
        left = total - sum(cap * sizes[i] for i in full)
        w = sum(x for i, x in enumerate(weights) if i not in full)
        out = [cap * s if i in full else left * weights[i] / w if w else 0 for i, s in enumerate(sizes)]
        over = {i for i, t in enumerate(out) if i not in full and t > cap * sizes[i] + 1e-9}
        if not over:
            return out
        full |= over


def test_mix_sources(spark):
    got = mixing.digest(mixing.mix_sources(frame(spark, ROWS)))
    a, b = rows_of(got), rows_of(mixing.digest(mixing.mix_sources(frame(spark, ROWS, partitions=5))))
    assert a == b and len(a) == len(ROWS)
    sizes = {}
    for x in ROWS:
        sizes[x[3]] = sizes.get(x[3], 0) + len((x[1] or "").encode().split())
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    want = dict(zip(names, waterfill([sizes[s] for s in names], [1 + k % 3 for k in range(len(names))]), strict=True))
    taken, largest = {}, {}
    full = mixing.mix_sources(frame(spark, ROWS)).collect()
    for x in full:
        assert abs(x["target"] - want[x["g0"]]) < 1e-6 and x["source_size"] == sizes[x["g0"]] and 0 <= x["copies"] <= 3
        taken[x["g0"]] = taken.get(x["g0"], 0) + x["size"] * x["copies"]
        largest[x["g0"], x["g1"]] = max(largest.get((x["g0"], x["g1"]), 0), x["size"])
    for s in names:
        assert abs(taken[s] - want[s]) <= sum(v / 2 + 1 for (g, _), v in largest.items() if g == s)
    assert mixing.mix_sources(frame(spark, EMPTY)).count() == 0


def rates_by_search(cells: dict, targets: dict, words: dict, cap: float, hold: float) -> dict:
    """The same optimum by plain coordinate steps: sources by bisection, languages by their own equation."""
    b = dict.fromkeys(words, 0.0)

    def level(s):
        low, high = 0.0, 1e6
        for _ in range(200):
            mid = (low + high) / 2
            if sum(n * min(cap, mid * np.exp(b[g])) for (x, g), n in cells.items() if x == s) < targets[s]:
                low = mid
            else:
                high = mid
        return low

    for _ in range(400):
        a = {s: level(s) for s in targets}
        for g in b:
            m = sum(n * min(cap, a[s] * np.exp(b[g])) for (s, h), n in cells.items() if h == g)
            b[g] += 0.3 * (hold * (1 - m / words[g]) - b[g])
    return {(s, g): min(cap, a[s] * np.exp(b[g])) for s, g in cells}


@pytest.mark.parametrize("seed", [2, 3])
def test_multipliers_tilt_to_the_optimum(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.randint(1, 90), r.choice("aaab" if seed == 2 else "abcd"), r.choice("xxyz"), r.getrandbits(60), i) for i in range(800)]
    rows = [x for x in rows if x[2:4] != ("b", "x")]
    sized = spark.createDataFrame(rows, "doc_id bigint, size bigint, g0 string, g1 string, u bigint, r bigint")
    cells, own, words = {}, {}, {}
    for _, n, s, g, _, _ in rows:
        cells[s, g], own[s], words[g] = cells.get((s, g), 0) + n, own.get(s, 0) + n, words.get(g, 0) + n
    total = sum(own.values())
    targets = {s: min(3.0 * n, total * (0.2 if s == "a" else 0.8 / (len(own) - 1))) for s, n in own.items()}
    t = spark.createDataFrame(list(targets.items()), "g0 string, target double")
    want = rates_by_search(cells, targets, words, 3.0, mixing.HOLD)
    got = mixing.balance(sized, t).collect()
    for x in got:
        assert abs(x["rate"] - want[x["g0"], x["g1"]]) < 1e-5
    assert len({round(x["rate"], 6) for x in got if x["g0"] == "a"}) == 3  # tilted within a source
    for s in targets:
        assert abs(sum(x["size"] * x["copies"] for x in got if x["g0"] == s) - targets[s]) <= 3 * 46


def test_targets_are_capped_and_reshared(spark):
    for sizes, weights in (([10, 200, 300], [1.0, 2.0, 3.0]), ([1, 1, 1000, 5, 0], [3.0, 2.0, 1.0, 1.0, 2.0]), ([7], [1.0]), ([0, 0], [1.0, 2.0])):
        df = spark.createDataFrame([(i, s, w) for i, (s, w) in enumerate(zip(sizes, weights))], "k int, size bigint, weight double")
        got = [x["target"] for x in mixing.capped_targets(df).orderBy("k").collect()]
        assert np.allclose(got, waterfill(sizes, weights), atol=1e-6)


def test_apply_mix_repeats_rows(spark):
    df = frame(spark, ROWS)
    got = mixing.apply_mix(df)
    assert got.columns == df.columns and untouched(got.collect())
    words = lambda x: len((x or "").encode().split())
    assert sum(words(x["text"]) for x in got.collect()) == sum(x["size"] * x["copies"] for x in mixing.mix_sources(df).collect())


def split_buckets(rows: list[tuple[int, int]], limit: int) -> dict[str, int]:
    """rows: 60-bit address, bytes. Extendible hashing, one split at a time."""
    out, todo = {}, [("", rows)] if rows else []
    while todo:
        name, own = todo.pop()
        if sum(b for _, b in own) <= limit or len(own) == 1:
            out[name] = sum(b for _, b in own)
            continue
        for bit in "01":
            part = [x for x in own if format(x[0], "060b")[len(name)] == bit]
            if part:
                todo.append((name + bit, part))
    return out


def test_sharding(spark):
    import hashlib

    rows = list({x[0]: x for x in ROWS if x[0] is not None}.values())
    df = frame(spark, rows)
    for limit in (200, 5000, 1 << 20):
        got = sharding.assign_shards(df, limit=limit)
        assert got.columns[: len(df.columns)] == df.columns and untouched(got.collect())
        sizes = {}
        for x in got.collect():
            name = x["shard_"]
            sizes[name] = sizes.get(name, 0) + len((x["text"] or "").encode())
            assert x["depth_"] == len(name)
        want = split_buckets([(int(hashlib.md5(str(x[0]).encode()).hexdigest()[:15], 16), len((x[1] or "").encode())) for x in rows], limit)
        assert sizes == want


def test_sharding_repeated_and_null_ids(spark):
    rows = [(1, "x" * 50, "en", "a")] * 40 + [(None, "y" * 50, "en", "a")] * 40 + [(7, "z" * 900, "en", "a")]
    got = sharding.assign_shards(frame(spark, rows, clashing=False), limit=200).collect()
    assert len(got) == 81
    sizes = {}
    for x in got:
        sizes.setdefault(x["shard"], []).append(len(x["text"]))
    assert all(sum(v) <= 200 or v == [900] for v in sizes.values())
    assert {x["shard"] for x in got if x["oversized"]} == {s for s, v in sizes.items() if v == [900]}
    assert sharding.assign_shards(frame(spark, EMPTY)).count() == 0


def test_write_shards(spark, tmp_path):
    rows = [(i, "x" * 100, "en", "a") for i in range(30)]
    sharding.write_shards(frame(spark, rows, clashing=False), f"file://{tmp_path}/shards", limit=500)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert back.count() == 30 and back.groupBy("shard").agg(F.sum(F.length("text")).alias("n")).agg(F.max("n")).first()[0] <= 500


def test_quality_learns_and_scores_all(spark):
    r = random.Random(4)
    clean = lambda: "\n".join(" ".join(r.choice(["the", "river", "and", "stone", "walks", "over", "green"]) for _ in range(20)) + "." for _ in range(4))
    junk = lambda: "\n".join(" ".join(r.choice(["BUY", "NOW"]) + "!!" for _ in range(20)) for _ in range(4))
    rows = [(i, clean() if i % 2 else junk(), "en", "a") for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1), (5, None), (9999, 0)], "doc_id bigint, quality int")
    got = quality.digest(frame(spark, rows + ROWS), labels).collect()
    assert len(got) == 300 + len(ROWS) and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in got)
    own = {x["doc_id"]: x for x in got if x["doc_id"] is not None and 100 <= x["doc_id"] < 300}
    held = [x for x in own.values() if x["held_out"]]
    assert held and sum(x["predicted"] == x["doc_id"] % 2 for x in held) / len(held) > 0.97
    kept = quality.keep_good(frame(spark, rows), labels)
    assert kept.columns == frame(spark, rows).columns and 130 <= kept.count() <= 170 and untouched(kept.collect())


def test_long_texts_are_scored_in_pieces(monkeypatch):
    r = np.random.default_rng(7)
    field = quality.Field(r.normal(size=quality.WIDTH), r.normal(size=(2, 2)))
    text = "\n".join(" ".join(r.choice(["aa", "Bb!", "c|", "12"], size=r.integers(0, 5))) for _ in range(700)) + "\n" + "x" * 900 + "\n\n"
    block = next(quality.blocks(quality.pa.array([text])))
    x, size, first = quality.line_features(block)
    want, _ = quality.marginals(field, x, first)
    monkeypatch.setattr(quality, "PIECE_BYTES", 200)
    monkeypatch.setattr(quality, "LONG_CHAIN", 10)
    score, lengths, at = quality.emissions(field, block)
    assert (lengths == size).all() and (at == first).all()
    assert np.abs(quality.good_lines(field, score, at) - want).max() < 1e-9
    for n in (11, 12, 16, 17, 50):
        assert np.abs(quality.good_lines(field, score[:n], np.array([0, n])) - quality.chains(score[:n], field.trans, np.array([0, n]))[0]).max() < 1e-9


def test_a_megabyte_of_empty_lines_takes_little():
    import tracemalloc

    field = quality.Field(np.ones(quality.WIDTH), np.eye(2))
    column = quality.pa.array(["\n" * (1 << 20)])
    tracemalloc.start()
    for block in quality.blocks(column, quality.PIECE_BYTES):
        score, _, first = quality.emissions(field, block)
        quality.good_lines(field, score, first)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6

def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {x["score"] for x in quality.digest(frame(spark, ROWS), none).collect()} == {0.5}
    one = spark.createDataFrame([(x[0], 1) for x in ROWS if x[0] is not None], "doc_id bigint, quality int")
    assert {x["score"] for x in quality.digest(frame(spark, ROWS), one).collect()} == {1.0}
    assert quality.digest(frame(spark, EMPTY), one).count() == 0


def test_forward_backward_is_exact():
    r = np.random.default_rng(1)
    x, first = r.normal(size=(9, quality.WIDTH)), np.array([0, 4, 5, 9])
    field = quality.Field(r.normal(size=quality.WIDTH), r.normal(size=(2, 2)))
    got, _ = quality.marginals(field, x, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        weight = {}
        for labels in np.ndindex(*(2,) * (b - a)):
            s = sum(x[a + t] @ field.weights * y for t, y in enumerate(labels)) + sum(field.trans[p, q] for p, q in zip(labels, labels[1:]))
            weight[labels] = np.exp(s)
        for t in range(b - a):
            assert abs(got[a + t] - sum(w for k, w in weight.items() if k[t]) / sum(weight.values())) < 1e-9


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(50)] + [(3, 3), (None, 4)]
    parent = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {x["node"]: x["label"] for x in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {v: find(v) for v in parent}


PAGES = {
    "<p>One<p>Two <b>b</b>": "One\n\nTwo b",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "- a\n- b\n  - c\n- d",
    "<ol start=3><li>x<li value=7>y</ol>": "3. x\n7. y",
    "<table><tr><th>Name<th>Qty<tr><td>Apple<td>3<tr><td>Fig<td>12</table>": "Name  | Qty\nApple | 3\nFig   | 12",
    "<table><tr><td rowspan=2>P<br>q<td>1<tr><td>2</table>": "P | 1\nq |\n  | 2",
    "a<div style='display:none'>x</div><span hidden>y</span>b": "ab",
    "<div style='visibility:hidden'>no<span style='visibility: visible'>yes</span></div>": "yes",
    "<head><title>t</title></head><script>var t='</p>';</script><style>p{}</style>x &amp; y &lt;z": "x & y <z",
    "<pre>a\n  b</pre>c": "a\n  b\n\nc",
    "<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details>": "S\nT\nyes",
    "<dl><dt>k<dd>v</dl>": "k\n  v",
    "<p>a</div></p>b<!-- x --><br>c": "a\n\nb\nc",
    "<table><tr><td>out<table><tr><td>in<td>x</table><td>y</table>": "out    | y\n       |\nin | x |",
    "<td>loose</td> <li>item": "loose\nitem",
    "": "",
    "   \n ": "",
    "<div>" * 3000 + "deep" + "</div>" * 3000: "deep",
    "<b>unclosed <i>tags <p>here": "unclosed tags\n\nhere",
    "x <a href='#' title=\"a > b\">link</a> <img src=a alt=no>y": "x link y",
}


def test_html_layout(spark):
    rows = [(i, h) for i, h in enumerate(PAGES)] + [(99, None), (99, None)]
    df = spark.createDataFrame([(i, h, "u", "t") for i, h in rows], "page_id bigint, html string, url string, text string")
    got = html_layout.extract(df)
    assert got.columns == ["page_id", "url", "text"]
    texts = [(x["page_id"], x["text"]) for x in got.collect()]
    assert sorted(texts) == sorted([(i, PAGES[h]) for i, h in rows[:-2]] + [(99, ""), (99, "")])
    assert html_layout.extract(df.limit(0)).count() == 0


def test_preferences(spark):
    turn = lambda r, t: {"role": r, "text": t}
    head = [turn("system", "s"), turn("user", "hi")]
    rows = [
        (1, head + [turn("assistant", "good"), turn("user", "more")], head + [turn("assistant", "bad")]),
        (2, head, head),
        (3, None, []),
        (4, [turn(None, None)], [turn("user", "x")]),
        (5, head, head + [turn("assistant", "only")]),
        (5, head, head + [turn("assistant", "only")]),
    ]
    df = spark.createDataFrame([(*x, "c") for x in rows], f"id bigint, chosen {chat_format.TURNS}, rejected {chat_format.TURNS}, prompt string")
    got = chat_format.format_preferences(df)
    assert got.columns == ["id", *chat_format.ADDED]
    x = {r["id"]: r for r in got.collect()}
    assert x[1]["n_common"] == 2 and x[1]["prompt"] == "<|system|>\ns<|end|>\n<|user|>\nhi<|end|>\n<|assistant|>\n"
    assert x[1]["chosen_completion"] == "good<|end|>\n<|user|>\nmore<|end|>\n" and x[1]["rejected_completion"] == "bad<|end|>\n"
    assert [x[1]["chosen_completion"][m["start"] : m["stop"]] for m in x[1]["chosen_mask"]] == ["good<|end|>\n"] and x[1]["usable"]
    assert x[2]["n_common"] == 2 and x[2]["chosen_completion"] == "" and not x[2]["usable"]
    assert x[3]["prompt"] == "" and x[4]["n_common"] == 0 and x[4]["chosen_completion"].startswith("<|unknown|>")
    assert x[5]["rejected_completion"] == "<|assistant|>\nonly<|end|>\n" and not x[5]["usable"]


def pair_of(chosen, rejected):
    """What format_preferences gives for a pair, turn by turn."""
    fix = lambda turns: [((t or {}).get("role") or "unknown", (t or {}).get("text") or "") for t in turns or ()]
    show = lambda r, t: f"<|{r}|>\n{t}<|end|>\n"
    a, b, n = fix(chosen), fix(rejected), 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    opened = n < min(len(a), len(b)) and a[n][0] == b[n][0] == "assistant"
    head = "<|assistant|>\n" if opened else ""

    def rest(turns):
        out, spans = "", []
        for k, (r, t) in enumerate(turns[n:]):
            piece = show(r, t)[len(head) if k == 0 else 0 :]
            if r == "assistant":
                spans.append((len(out) + len(piece) - len(t) - 8, len(out) + len(piece)))
            out += piece
        return out, spans

    (ta, ma), (tb, mb) = rest(a), rest(b)
    return n, "".join(show(*t) for t in a[:n]) + head, ta, ma, tb, mb, bool(ma and mb)


def test_preferences_like_turn_by_turn(spark):
    r = random.Random(11)
    turn = lambda: {"role": r.choice(["user", "assistant", "assistant", None, ""]), "text": r.choice(["", "a b", "é漢字", None, "long " * 20])}
    rows = []
    for i in range(150):
        head = [turn() for _ in range(r.randint(0, 4))]
        rows.append((i, head + [turn() for _ in range(r.randint(0, 4))], head + [turn() for _ in range(r.randint(0, 4))]))
    got = chat_format.format_preferences(spark.createDataFrame(rows, f"id bigint, chosen {chat_format.TURNS}, rejected {chat_format.TURNS}")).collect()
    want = {i: pair_of(a, b) for i, a, b in rows}
    for x in got:
        spans = lambda c: [(m["start"], m["stop"]) for m in x[c]]  # noqa: B023, E731
        assert (x["n_common"], x["prompt"], x["chosen_completion"], spans("chosen_mask"), x["rejected_completion"], spans("rejected_mask"), x["usable"]) == want[x["id"]]


def test_shortened_reply_pairs(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a b c d"), (1, 2, "user", "bye"), (2, 0, "user", None), (None, None, None, None), (3, 1, "assistant", "x"), (3, 1, "assistant", "x")]
    rows += [(4, k, "assistant" if k % 2 else "user", f"t{k} and more words") for k in range(12)]
    df = spark.createDataFrame([(*x, "c") for x in rows], "conv_id bigint, turn bigint, role string, text string, chosen string")
    got = {r["conv_id"]: r for r in chat_format.digest(chat_format.format_preferences(chat_format.shortened_reply_pairs(df))).collect()}
    assert (got[1]["chosen_completion"], got[1]["rejected_completion"], got[1]["chosen_mask"]) == ("a b c d<|end|>\n<|user|>\nbye<|end|>\n", "a b<|end|>\n<|user|>\nbye<|end|>\n", "0:15")
    assert got[2]["n_common"] == 1 and got[None]["prompt"] == "<|unknown|>\n<|end|>\n" and got[3]["rejected_completion"].startswith("<|end|>\n")
    assert got[4]["n_common"] % 2 == 1 and got[4]["chosen_mask"].count(":") == (12 - got[4]["n_common"] + 1) // 2
    assert chat_format.shortened_reply_pairs(df.limit(0)).count() == 0


class Seen(HTMLParser):
    """Words that show, by another parser: no tree, only what is open and hidden."""

    HIDDEN = frozenset("head script style template noscript title iframe textarea_ audio video canvas".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.stack = [], []

    def handle_starttag(self, tag, attrs):
        if tag in html_layout.VOID:
            self.text.append(" ")
            return
        a = dict(attrs)
        gone = tag in self.HIDDEN or "hidden" in a or "display:none" in (a.get("style") or "").replace(" ", "")
        if tag in html_layout.BLOCK and not gone and not any(g for _, g in self.stack):
            self.text.append(" ")
        self.stack.append((tag, gone))

    def handle_endtag(self, tag):
        hidden = any(g for _, g in self.stack)
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass
        if tag in html_layout.BLOCK and not hidden:
            self.text.append(" ")

    def handle_data(self, data):
        if not any(g for _, g in self.stack):
            self.text.append(data)


def random_page(r: random.Random, deep: int = 0) -> str:
    """Well-formed pages of nested blocks, lists, tables and hidden parts."""
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 8)))
    text = lambda: " ".join(word() for _ in range(r.randint(1, 6)))
    out = []
    for _ in range(r.randint(1, 4)):
        kind = r.randrange(11) if deep < 4 else 0
        inner = lambda: random_page(r, deep + 1)
        if kind == 1:
            out.append(f"<div>{inner()}</div>")
        elif kind == 2:
            out.append("<ul>" + "".join(f"<li>{inner()}</li>" for _ in range(r.randint(1, 3))) + "</ul>")
        elif kind == 3:
            rows = "".join("<tr>" + "".join(f"<td{r.choice(['', ' colspan=2', ' rowspan=2'])}>{inner()}</td>" for _ in range(r.randint(1, 3))) + "</tr>" for _ in range(r.randint(1, 3)))
            out.append(f"<table>{r.choice(['', '<caption>' + text() + '</caption>'])}{rows}</table>")
        elif kind == 4:
            out.append(f"<script>var {word()} = 1;</script><style>{word()} {{}}</style>")
        elif kind == 5:
            out.append(f"<div style='display: none'>{inner()}</div>")
        elif kind == 6:
            out.append(f"<section hidden>{inner()}</section>")
        elif kind == 7:
            out.append(f"<b>{text()}</b> <i>{text()}</i>")
        elif kind == 8:
            out.append(f"<select><option>{text()}</option><option>{text()}</option></select>")
        elif kind == 9:
            out.append(f"<blockquote><h2>{text()}</h2>{inner()}</blockquote>")
        else:
            out.append(f"<p>{text()} &amp; {text()}</p>")
    return "".join(out)


def shown_words(html: str) -> list[str]:
    p = Seen()
    p.feed(html)
    p.close()
    return sorted("".join(p.text).split())


def rendered_words(html: str) -> list[str]:
    """The words of the rendering without what it adds: list marks, rules and column bars."""
    lines = [re.sub(r"^(\s*(-|\d+\.) )+", "", x) for x in html_layout.page_text(html).split("\n")]
    return sorted(w for x in lines for w in x.split() if w not in ("|", "----", "-"))


def test_no_visible_word_is_lost():
    r = random.Random(9)
    for _ in range(400):
        page = random_page(r)
        assert rendered_words(page) == [w for w in shown_words(page) if w not in ("|", "-")]


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/pages.parquet"), reason="no tables here")
def test_no_word_of_the_pages_is_lost():
    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        have = Counter(re.findall(r"\w+", " ".join(rendered_words(page or ""))))
        want = Counter(re.findall(r"\w+", " ".join(shown_words(page or ""))))
        assert not want - have, (want - have, page)
