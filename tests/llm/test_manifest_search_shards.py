"""Merkle manifest, ranked search and sharding against brute force."""
import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from llm_cases import SCHEMA, cases, frame, prepared, prose  # noqa: F401
from pyspark.sql import functions as F

from capgraph.llm import op11_merkle as merkle
from capgraph.llm import op12_ranked_search as ranked
from capgraph.llm import op13_sharding as sharding

DOCS = "doc_id bigint, text string, lang string, source string, n_chars int, size int, shard int, rank int, block int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """Levels of the whole tree."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def leaf_of(*fields):
    return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))


def manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) of rows (doc_id, source, lang, n_chars, text)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
    trees = {g: tree([leaf_of(*r) for r in groups[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            own = leaf_of(*r)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf_of(*r[:4], None if r[4] is None else r[4].translate(lower)) if changed else own
            proof = []
            for levels, at in ((trees[g], i), (top, k)):
                for level in levels[:-1]:
                    run = list(level[at - at % 8:at - at % 8 + 8])
                    proof += run[:at % 8] + run[at % 8 + 1:]
                    run[at % 8] = node
                    node, at = sha(*run), at // 8
            out.append((r[0], own, trees[g][-1][0], top[-1][0], sha(*proof), node))
    return out


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 1, 1) for r in rows], DOCS).repartition(3)


def found_manifest(spark, rows, depth):
    docs = documents(spark, [(i, t, lang, s, n) for i, s, lang, n, t in rows])
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    got = merkle.manifest(merkle.leaves(docs, when=third, tampered={"text": F.translate("text", merkle.UPPER, merkle.LOWER)}), depth)
    return got.collect()


@pytest.mark.parametrize("depth", [1, 4])
def test_manifest_is_the_whole_trees(spark, depth):
    """With blocks of 8 leaves the tree has many levels; with 4096 one block a language."""
    rows = [(i, "s", (None, "en", "é", "")[k % 4 if k % 5 else 1], k, t and t.title()) for k, (i, t) in enumerate(cases())]
    rows += [(1000 + k, None, "en", None, f"Text {k % 50}") for k in range(150)] + [(7, "x", "lone", 1, "A"), (77, "Copy", "en", 2, "Same")] * 2
    got = found_manifest(spark, rows, depth)
    key = lambda x: tuple(str(y) for y in x)
    assert sorted(((r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in got), key=key) == sorted(manifest(rows), key=key)
    assert all(r.verified == (r.folded_root == r.root) for r in got)
    assert any(not r.verified for r in got) and all((r.copied or [r.folded_root])[-1] == r.folded_root for r in got)


def test_manifest_of_little(spark):
    assert found_manifest(spark, [], 4) == []
    one = found_manifest(spark, [(1, None, None, None, None)], 4)[0]
    assert one.leaf == one.subroot == one.root == sha("-".replace("-", "1:1"), "----") and one.verified
    assert one.proof_sha256 == sha("")
    many = [(k, "s", f"l{k}", 1, "x") for k in range(70)]  # more languages than a run holds
    assert sorted(r.proof_sha256 for r in found_manifest(spark, many, 1)) == sorted(m[4] for m in manifest(many))


# -- search -----------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(t):
    return TERM.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def best(rows, items, k):
    counted = [(i, Counter(words(t))) for i, t in rows]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n, length = len(counted), sum(x for *_, x in counted)
    df = Counter(w for _, c, _ in counted for w in c)
    out = []
    for item, t in items:
        scores = []
        for i, c, own in counted:
            m = 100 - 25 + 25 * own * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10 ** 9 * c[w] // (1000 * c[w] + 12 * m))
                    for w in words(t) if w in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return out


ITEMS = [(1, "w3x1 the w7x2 W7X2 cat"), (2, None), (3, "..."), (4, "nothing known qqqq"), (5, prose(99, 60)), (5, "is of"),
         (None, "漢🙂 é one ab" + "ab" * 699), (6, prose(7, 400)), (7, "the the the a and THE")]


def searched(spark, rows, items, **bounds):
    docs = spark.createDataFrame([(i, t, 1, 1, 1, 1) for i, t in rows], "doc_id bigint, text string, item int, score int, rank int, ids int").repartition(4)
    asked = spark.createDataFrame([(i, t, 1, 1) for i, t in items], "item_id bigint, text string, row int, doc_id int")
    return [(r.item_id, r["rank"], r.doc_id, r.score) for r in ranked.search(docs, asked, **bounds).collect()]


@pytest.mark.parametrize("bounds", [{}, {"block_docs": 3}, {"block_bytes": 500, "batch_bytes": 300}])
def test_search_finds_the_best(spark, bounds):
    rows = cases() + [(500 + k, prose(k % 9, 25)) for k in range(60)]
    key = lambda x: tuple((y is None, y or 0) for y in x)
    assert sorted(searched(spark, rows, ITEMS, **bounds), key=key) == sorted(best(rows, ITEMS, 20), key=key)


def test_search_of_little(spark):
    assert searched(spark, [], ITEMS) == [] and searched(spark, cases(), []) == []
    assert searched(spark, [(1, None), (2, "...")], ITEMS) == []
    one = [(1, "a a"), (2, "b")]
    assert searched(spark, one, [(9, "A b")], k=1) == best(one, [(9, "A b")], 1)


def test_treap_holds_every_point():
    import numpy as np
    rng = np.random.default_rng(1)
    points = np.unique(rng.integers(0, 40, (300, 2)), axis=0)
    values = rng.integers(1, 1000, len(points))
    t = ranked.Treap.build(points[:, 0], points[:, 1], values)
    for row in range(40):
        got = {}

        def give(columns, scores):
            got.update(zip(columns.tolist(), scores.tolist()))
            return 0

        top = values[points[:, 0] == row].max(initial=0)
        t.search(np.array([row]), np.array([2]), np.array([top]), 0, give)
        assert got == {c: 2 * v for (r, c), v in zip(points.tolist(), values.tolist()) if r == row}


# -- shards -----------------------------------------------------------------------

def cut(rows, shards, tolerance):
    """(doc_id, shard, slot) of rows that all differ, by the cells of all depths."""
    def key(i, t):
        return hashlib.md5((t or "").encode()).hexdigest()[:14] + f"{0 if i is None else i + (1 << 63):016x}"

    found = sorted((key(i, t), i, len((t or "").encode()) + 1) for i, t in rows)
    total = sum(x[2] for x in found)
    starts = []
    for s in range(1, shards):
        target, allowed = s * total // shards, int(tolerance * total / shards)
        for depth in range(1, 16):
            cells = {}
            for at, (k, _, size) in enumerate(found):
                cells.setdefault(k[:2 * depth], []).append((at, size))
            below = 0
            for cell in cells.values():
                size = sum(x for _, x in cell)
                if below + size > target:
                    break
                below += size
            short, over = target - below, below + size - target
            if min(short, over) <= allowed or len(cell) == 1:
                starts.append(cell[0][0] if short <= over else cell[-1][0] + 1)
                break
    out, slots = [], Counter()
    for at, (_, i, _) in enumerate(found):
        shard = sum(at >= x for x in starts)
        out.append((i, shard, slots[shard]))
        slots[shard] += 1
    return out


@pytest.mark.parametrize("shards,tolerance", [(8, 0.001), (3, 0.2), (40, 0.0), (1, 0.1)])
def test_shards_are_the_histograms_cuts(spark, shards, tolerance):
    rows = list(dict.fromkeys(cases())) + [(700 + k, f"copy {k % 4}" * 30) for k in range(200)] + [(-5, "negative id")]
    docs = spark.createDataFrame([(i, t, 1, 1) for i, t in rows], "doc_id bigint, text string, size int, key int").repartition(3)
    got = sharding.placed(docs, shards, tolerance).collect()
    key = lambda x: tuple((y is None, y or 0) for y in x)
    assert sorted(((r.doc_id, r.shard, r.slot) for r in got), key=key) == sorted(cut(rows, shards, tolerance), key=key)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].size == len((t or "").encode()) + 1 and by_id[i].text_crc32 == zlib.crc32((t or "").encode())
               for i, t in rows if i is not None and sum(j == i for j, _ in rows) == 1)


def test_equal_rows_are_spread(spark):
    rows = [(None, "the same text")] * 3000 + [(k, f"text {k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sharding.placed(docs, 4).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert len(got) == 3040 and max(sizes.values()) - min(sizes.values()) <= 2 * 14 + 2 * 0.001 * sum(sizes.values()) / 4
    for shard in range(4):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_shards_of_little(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert sharding.placed(none).collect() == []
    few = sharding.placed(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")).collect()
    assert sorted((r.size, r.text_crc32, r.slot) for r in few) == [(1, 0, 0), (1, 0, 0)]


def test_long_frames_have_the_schema_they_say(spark):
    got = sharding.placed(frame(spark))
    assert got.columns == ["doc_id", "size", "text_crc32", "shard", "slot"] and SCHEMA
