"""Small documents with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: columns that operators might call their own, none of them null
CLASHING = {
    "n_hit": 5, "chunk": "c", "r": 7, "label": "l", "score": "s", "copies": 2, "shard": "x", "_u": "u", "_c": 9, "_score": 0.5, "hits": "h", "u": 8, "g0": "g", "g1": 3, "m_n_words": 4,
    "_row": 6, "_no": 1, "_id": 77, "_y": 1, "i": 5, "y": 1, "t": "tt", "depth": "d", "bits": "b", "row": "w", "_kept": 11, "_single": 0, "order": 12, "items": "it", "matches": "m", "n_words": 13, "size": 14, "target": 0.25, "k1": 2,
}


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    """doc_id, text, lang, source: plain texts, copies, near copies, shared passages, repeated rows, nulls, empty and long texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmnoprstuvwyz") for _ in range(r.randint(2, 9))) for _ in range(400)]
    sentence = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passages = [sentence(60) for _ in range(3)]
    rows = []
    for i in range(n):
        kind = r.random()
        if rows and kind < 0.15:
            text = r.choice(rows)[1]
        elif rows and kind < 0.45:
            words = (r.choice(rows)[1] or "x y").split(" ")
            for _ in range(r.randint(1, max(1, len(words) // 40))):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            text = " ".join(words)
        elif kind < 0.6:
            text = f"{sentence(r.randint(1, 60))}\n{r.choice(passages)}\n  {sentence(20).upper()} "
        else:
            text = "\n".join(sentence(r.randint(1, 40)) for _ in range(r.randint(1, 6)))
        rows.append((i, text, "en", r.choice(["a", "b", "b", "b", None])))
    hot = sentence(80)
    rows += [(n + i, hot if i % 2 else hot + " " + sentence(2), "en", "b") for i in range(20)]
    rows += [(n + 20, None, None, None), (n + 21, "", "de", ""), (n + 22, " \t\n ", None, "a"), (n + 23, "one two", "en", "a"), (n + 24, "One  TWO", "en", "a"), (n + 25, "über straße ñandú 漢字 " * 30, "de", "b")]
    rows += [(n + 26, "aaaa " * 400, "en", "b"), (n + 27, "a" * 3000, "en", "b"), (n + 28, sentence(9000) + "\n" + passages[0], "en", "a"), (None, passages[1], "en", "a"), (None, None, None, None)]
    rows += [rows[3], rows[3], (n + 21, "", "de", "")]
    r.shuffle(rows)
    return rows


def frame(spark, rows: list[tuple], clashing: bool = True, partitions: int = 3):
    schema = "doc_id bigint, text string, lang string, source string"
    if clashing:
        kinds = {str: "string", int: "bigint", float: "double"}
        schema += "".join(f", {c} {kinds[type(v)]}" for c, v in CLASHING.items())
        rows = [(*x, *CLASHING.values()) for x in rows]
    return spark.createDataFrame(rows, schema).repartition(partitions)


def untouched(rows: list) -> bool:
    """Whether the clashing columns came back as they were."""
    return all(x[c] == v for x in rows for c, v in CLASHING.items())


def rows_of(df) -> list[tuple]:
    return sorted((tuple(x) for x in df.collect()), key=repr)


def shingles(text: str | None) -> frozenset:
    w = (text or "").encode().translate(LOWER).split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(zip(w, w[1:], w[2:], w[3:], w[4:]))


def components(rows: list[tuple]) -> list[tuple]:
    sets = [shingles(x[1]) for x in rows]
    parent = list(range(len(rows)))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least: dict[int, int | None] = {}
    for i, x in enumerate(rows):
        if x[0] is not None:
            least[find(i)] = min(least.get(find(i), x[0]), x[0])
    return sorted(((x[0], len(sets[i]), least.get(find(i)) if sets[i] else x[0]) for i, x in enumerate(rows)), key=repr)


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(rows: list[tuple], items: list[tuple]) -> list[tuple]:
    windows: dict[tuple, set[str]] = {}
    for item, text in items:
        w = WORD.findall((text or "").encode().translate(LOWER))
        for p in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[p : p + 10]), set()).add("" if item is None else str(item))
    out = []
    for x in rows:
        w = WORD.findall((x[1] or "").encode().translate(LOWER))
        hit, found = set(), set()
        for size in {len(k) for k in windows}:
            for p in range(len(w) - size + 1):
                if (k := tuple(w[p : p + size])) in windows:
                    hit.update(range(p, p + size))
                    found |= windows[k]
        out.append((x[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def suffix_dedup(rows: list[tuple], length: int = 50) -> list[tuple]:
    ids = [float("inf") if x[0] is None else x[0] for x in rows]
    texts = [(x[1] or "").encode() for x in rows]
    first: dict[bytes, float] = {}
    for i, t in zip(ids, texts, strict=True):
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t, x in zip(ids, texts, rows, strict=True):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((x[0], len(t), sum(gone), sum(1 for z in bytes(gone).split(b"\0") if z), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


SPACES = " \t\n\x0b\f\r"


def lines(rows: list[tuple]) -> list[tuple]:
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    owner: dict[str, float] = {}
    for x in rows:
        i = float("inf") if x[0] is None else x[0]
        for line in (x[1] or "").split("\n"):
            k = line.strip(SPACES).translate(upper)
            owner[k] = min(owner.get(k, i), i)
    out = []
    for x in rows:
        i = float("inf") if x[0] is None else x[0]
        have = (x[1] or "").split("\n")
        kept = [y for y in have if len(k := y.strip(SPACES).translate(upper)) < 10 or owner[k] >= i]
        out.append((x[0], len(have), len(have) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def measures(text: str | None) -> tuple:
    w = (text or "").encode().split()
    tri = list(zip(w, w[1:], w[2:]))
    count: dict[tuple, int] = {}
    for x in tri:
        count[x] = count.get(x, 0) + 1
    again = {p + j for p, x in enumerate(tri) if count[x] > 1 for j in range(3)}
    full = [x for x in (text or "").split("\n") if x.strip(SPACES)]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(full) - len(set(full)), len(again)
