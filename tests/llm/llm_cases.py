"""Rows that every operator must cope with, and brute-force versions."""

from __future__ import annotations

import random

import pytest

SF_SMALL = "/root/testdata/sf0.001"
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars int, shard int, key string, body string, "
          "row string, cls string, found string, size int")


@pytest.fixture(autouse=True)
def prepared(spark):
    """Imported by the test modules, so it holds for all their tests."""
    from capgraph.llm.common import prepare
    prepare(spark)


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    pool = [f"w{rng.randrange(vocabulary)}x{k % 7}" for k in range(vocabulary)] + ["the", "of", "is", "a", "and"] * 40
    return " ".join(rng.choice(pool) for _ in range(words))


def cases() -> list[tuple[int | None, str | None]]:
    """(doc_id, text): nulls, empty and very long texts, copies, repeated rows,
    rows that share an id, shared passages, unusual characters."""
    passage = prose(99, 90)
    long = prose(7, 9000)
    base = prose(3, 160)
    near = base.split()
    near[80] = "changed"
    rows = [(k, prose(100 + k, 30 + 9 * k)) for k in range(12)]
    rows += [(20, None), (21, ""), (22, "   \n\t "), (23, "one"), (24, "one two three"), (25, long),
             (26, base), (27, base), (28, " ".join(near)), (29, prose(40, 50) + " " + passage + " " + prose(41, 40)),
             (30, passage + " " + prose(42, 60)), (31, "ab" * 700), (32, "é漢🙂 <|endoftext|> 'Tis ΟΔΟΣ İ ﬁ́ \x1c x\x85y"),
             (33, "The cat " * 120), (34, "THE!! CAT!! " * 60), (35, long[:30000] + " tail"),
             (26, base), (None, prose(50, 70)), (None, None), (36, prose(51, 44)), (36, prose(52, 44))]
    return rows


def frame(spark, rows=None):
    rows = cases() if rows is None else rows
    return spark.createDataFrame([(i, t, None if k % 5 == 0 else "en", None, None, 1, "k", "b", "r", "c", "f", 2)
                                  for k, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


def text(t: str | None) -> str:
    return t or ""


def repeated_bytes(rows, window: int):
    """(doc_id, text) -> (removed spans, kept bytes), by comparing all windows."""
    seen: dict[bytes, int] = {}
    bodies = [text(t).encode() for _, t in rows]
    for b in bodies:
        for k in range(len(b) - window + 1):
            seen[b[k:k + window]] = seen.get(b[k:k + window], 0) + 1
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if seen[b[k:k + window]] > 1:
                gone[k:k + window] = b"\1" * window
        out.append(spans_of(gone) + (bytes(x for x, g in zip(b, gone) if not g),))
    return out


def again_bytes(rows, window: int):
    """Like ``repeated_bytes``, for strings that occurred before (lower id, then
    lesser text, then earlier place) only."""
    order = sorted(range(len(rows)), key=lambda i: (-(1 << 63) if rows[i][0] is None else rows[i][0], text(rows[i][1]).encode()))
    seen, out = set(), [None] * len(rows)
    for i in order:
        b = text(rows[i][1]).encode()
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if b[k:k + window] in seen:
                gone[k:k + window] = b"\1" * window
            seen.add(b[k:k + window])
        out[i] = spans_of(gone) + (bytes(x for x, g in zip(b, gone) if not g),)
    return out


def spans_of(gone):
    spans, at = [], None
    for k, g in enumerate([*gone, 0]):
        if g and at is None:
            at = k
        elif not g and at is not None:
            spans.append((at, k))
            at = None
    return (spans,)


def repeated_words(rows, window: int):
    """Like ``repeated_bytes``, for words and earlier occurrences only."""
    order = sorted(range(len(rows)), key=lambda i: (-(1 << 63) if rows[i][0] is None else rows[i][0], text(rows[i][1]).encode()))
    seen, out = set(), [None] * len(rows)
    for i in order:
        words = text(rows[i][1]).encode().split()
        gone = [0] * len(words)
        for k in range(len(words) - window + 1):
            w = tuple(words[k:k + window])
            if w in seen:
                gone[k:k + window] = [1] * window
            seen.add(w)
        out[i] = spans_of(gone) + (b" ".join(w for w, g in zip(words, gone) if not g), len(words))
    return out


def shingle_set(t: str | None, size: int = 5):
    words = text(t).encode().split()
    size = min(size, len(words))
    return {tuple(words[k:k + size]) for k in range(len(words) - size + 1)} if words else set()


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


def near_groups(rows, threshold: float = 0.8):
    """For each row: the rows of its component, and its number of links."""
    sets = [shingle_set(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= threshold - 1e-12:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    members: dict[int, list[int]] = {}
    for i in range(len(rows)):
        members.setdefault(root(i), []).append(i)
    return [members[root(i)] for i in range(len(rows))], links
