"""Fingerprints, repeated strings, near duplicates."""
import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import again_bytes, cases, frame, jaccard, near_groups, prose, repeated_bytes, repeated_words, shingle_set, text, prepared  # noqa: F401

from capgraph.llm import common, shards
from capgraph.llm import op1_fingerprints as spots
from capgraph.llm import op6_suffix_dedup as suffixes
from capgraph.llm import op8_substring_dedup as sequences
from capgraph.llm import op10_ngram_join as near


@pytest.mark.parametrize("rows_per_range", [1000, 4])
def test_edited_texts_follow_falling_ids(spark, rows_per_range):
    rows = [(i, t) for k, (i, t) in enumerate(cases()) if i is not None and (i, t) not in cases()[:k] and i != 36]
    got = {r.doc_id: r for r in spots.with_edited(frame(spark, rows), rows_per_range=rows_per_range).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])
    find = spots.Signatures()
    for k, (i, t) in enumerate(order):
        t, after = text(t), text(order[(k + 1) % len(order)][1])
        edited = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        r = got[i]
        own, changed, other = (set(find(x.encode()).tolist()) for x in (t, edited, after))
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert set(spots.unpacked(r.fingerprint).tolist()) == own
        assert r.near_edited == pytest.approx(jaccard(own, changed)) and r.near_next == pytest.approx(jaccard(own, other))


def test_edited_texts_with_null_and_repeated_ids(spark):
    rows = spots.with_edited(frame(spark), rows_per_range=4).collect()
    assert sorted((r.doc_id or -1) for r in rows) == sorted((i or -1) for i, _ in cases())
    assert spots.with_edited(frame(spark, [])).count() == 0
    (one,) = spots.with_edited(frame(spark, [(5, "abcd")])).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1


def test_fingerprints_of_odd_texts(spark):
    rows = {r.doc_id: r for r in spots.fingerprints(frame(spark)).collect()}
    assert rows[20].fingerprint == rows[21].fingerprint == rows[22].fingerprint == ""
    assert rows[26].fingerprint == rows[27].fingerprint and rows[23].n_signatures == 1
    find = spots.Signatures()
    a, b = find(prose(3, 300).encode()), find(prose(4, 300).encode())
    assert spots.likeness(a, a) == 1 and spots.likeness(a, b) < 0.1 and spots.likeness(a, a[:3], 0.5) == 0
    assert (spots.unpacked(spots.packed(a)) == a).all()
    for t in (0.2, 0.5, 0.8):
        for k in (1, len(a) // 3, len(a)):
            exact = jaccard(set(a.tolist()), set(a[:k].tolist()))
            assert spots.likeness(a, a[:k], t) == (pytest.approx(exact) if exact >= t else pytest.approx(0) if
                                                   spots.likeness(a, a[:k], t) == 0 else pytest.approx(exact))


def test_fingerprints_grow_with_texts_of_few_anchors():
    find = spots.Signatures()
    words = [f"v{k * 7919 % 1009}q" for k in range(300)]
    few = words[:150] + ["la"] + words[150:]
    dense, one = find(" ".join(words).encode()), find(" ".join(few).encode())
    assert len(one) > 60 and spots.likeness(dense, one) > 0.9  # across what was a switch
    other = few[:151] + few[151:155] + [f"z{k}" for k in range(145)]
    assert spots.likeness(one, find(" ".join(other).encode())) < 0.6  # half the text outside the chain
    inside = few[:152] + ["changed"] + few[153:]
    assert 0.9 < spots.likeness(one, find(" ".join(inside).encode())) < 1
    short = find(" ".join(few[130:170]).encode())
    assert spots.likeness(short, find(" ".join(words[130:170]).encode())) > 0.4
    rng = np.random.default_rng(1)
    script = "".join(chr(0x4E00 + c) for c in rng.integers(0, 3000, 400))
    near_script = script[:200] + "漢" + script[201:]
    assert len(find(script.encode())) > 100
    assert 0.9 < spots.likeness(find(script.encode()), find(near_script.encode())) < 1
    prose_ = "the cat sat house is red door was open wide that green tree a tall hill this small boat".encode()
    assert len(find(prose_)) == 5  # the, is, was, that, a; nothing plain is left between


@pytest.mark.parametrize("window,shard_bytes", [(400, 1 << 24), (64, 20_000)])
def test_repeated_strings_match_brute_force(spark, window, shard_bytes):
    rows = suffixes.repeated_spans(frame(spark), window, shard_bytes=shard_bytes).collect()
    got = sorted(((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in rows), key=repr)
    want = [(i, len(text(t).encode()), spans, kept) for (i, t), (spans, kept) in zip(cases(), repeated_bytes(cases(), window))]
    assert got == sorted(want, key=repr)


def test_strips_cut_long_texts_without_a_trace(monkeypatch):
    body = (prose(1, 700) + prose(2, 60) + prose(1, 700)).encode()
    want = sorted(set(np.concatenate([s.hashes(w, 400) for s, w, _ in _windows([body], suffixes.STRIP)]).tolist()))
    got = sorted(set(np.concatenate([s.hashes(w, 400) for s, w, _ in _windows([body], 1500)]).tolist()))
    assert set(want) <= set(got)


def _windows(bodies, size):
    for strip in suffixes.strips(bodies, 400, size):
        at, phrase = strip.parse()
        starts = strip.candidates(at, np.zeros(len(at), bool))
        if len(starts):
            yield strip, starts, None


def test_repeated_strings_of_empty_tables(spark):
    assert suffixes.repeated_spans(frame(spark, [])).count() == 0
    assert sequences.repeated_sequences(frame(spark, [])).count() == 0
    assert near.near_links(frame(spark, [])).count() == 0


def test_without_repeats_keeps_columns_and_whole_characters(spark):
    rows = [(1, "é" + "漢" * 200), (2, "x" + "漢" * 200 + "é"), (3, "clean text"), (4, None)]
    out = {r.doc_id: r for r in suffixes.without_repeats(frame(spark, rows)).collect()}
    assert out[1].text == "é" and out[2].text == "xé" and out[3].text == "clean text" and out[4].text == ""
    assert out[1].n_chars == 1 and out[3].key == "k" and out[3].body == "b"


@pytest.mark.parametrize("window,prefix", [(20, 8), (6, 3)])
def test_repeated_sequences_match_brute_force(spark, window, prefix):
    rows = sequences.repeated_sequences(frame(spark), window, prefix, shard_bytes=20_000).collect()
    got = sorted(((r.doc_id, r.n_words, [tuple(s) for s in r.spans], bytes(r.kept)) for r in rows), key=repr)
    want = [(i, n, spans, kept) for (i, _), (spans, kept, n) in zip(cases(), repeated_words(cases(), window))]
    assert got == sorted(want, key=repr)


def lopsided():
    """Long texts side by side, one id with a third of the bytes and a shared
    opening, and one row many times."""
    opening = prose(70, 30)
    rows = [(k, prose(300 + k, 20)) for k in range(60)] + [(100 + k, prose(400 + k, 500)) for k in range(20)]
    rows += [(None, f"{opening} {prose(500 + k, 120)}") for k in range(60)] + [(200, prose(1, 300))] * 30
    return rows + [(None, opening), (None, None), (40, prose(8, 300))]


def test_shards_are_bounded_by_bytes(spark):
    docs = frame(spark, lopsided())
    made = shards.Shards(common.id_text(docs), 8000)
    rows = made.frame.collect()
    assert len(rows) == len(lopsided())
    by_shard: dict[int, list] = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append((r.key, bytes(r.body)))
    longest = max(len(text(t).encode()) for _, t in lopsided())
    assert all(sum(len(b) for _, b in held) <= 8000 + longest for held in by_shard.values())
    held = [by_shard[k] for k in sorted(by_shard)]
    assert all(max(a) <= min(b) for a, b in zip(held, held[1:]))  # in order of id, then text
    assert sum(any(k == shards.LOWEST for k, _ in x) for x in held) > 3 and sum((200, prose(1, 300).encode()) in x for x in held) > 3


def test_lopsided_texts_match_brute_force(spark):
    rows = sequences.repeated_sequences(frame(spark, lopsided()), 6, 3, shard_bytes=8000).collect()
    got = sorted(((r.doc_id, r.n_words, [tuple(s) for s in r.spans], bytes(r.kept)) for r in rows), key=repr)
    want = [(i, n, spans, kept) for (i, _), (spans, kept, n) in zip(lopsided(), repeated_words(lopsided(), 6))]
    assert got == sorted(want, key=repr)
    rows = suffixes.repeated_spans(frame(spark, lopsided()), 64, shard_bytes=8000).collect()
    got = sorted(((r.doc_id, [tuple(s) for s in r.spans], bytes(r.kept)) for r in rows), key=repr)
    want = [(i, spans, kept) for (i, _), (spans, kept) in zip(lopsided(), repeated_bytes(lopsided(), 64))]
    assert got == sorted(want, key=repr)


def families():
    rows = cases()
    base = prose(60, 120).split()
    for k in range(14):  # near copies, some of them of each other only
        words = list(base)
        for j in range(k // 2):
            words[(11 * j + 5 * k) % 120] = f"edit{k}"
        rows.append((200 + k, " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [4096, 3])
def test_near_links_match_brute_force(spark, block):
    rows = families()
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in near.near_links(frame(spark, rows), block=block).collect()), key=repr)
    groups, links = near_groups(rows)
    least = [min((rows[j][0] for j in g if rows[j][0] is not None), default=None) for g in groups]
    assert got == sorted(((i, c, n) for (i, _), c, n in zip(rows, least, links)), key=repr)


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_near_fingerprints_match_brute_force(spark, threshold):
    rows = families()
    find = spots.Signatures()
    sets = [set(find(text(t).encode()).tolist()) for _, t in rows]
    links = [sum(jaccard(a, b) >= threshold - 1e-12 for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    got = spots.near_duplicates(frame(spark, rows), threshold).collect()
    assert sorted(((r.doc_id, r.n_links) for r in got), key=repr) == sorted(((i, n) for (i, _), n in zip(rows, links)), key=repr)
    assert sum(links) > 40


def test_texts_with_only_a_frequent_passage_in_common_do_not_meet(spark, monkeypatch):
    rows = [(k, prose(1000 + k, 200) + " " + prose(900, 200)) for k in range(40)] + [(40, prose(1000, 200) + " " + prose(900, 200) + " tail")]
    met, clusters = [], near.clusters

    def counted(signed):
        found = clusters(signed)
        met.append(found.count())
        return found

    monkeypatch.setattr(near, "clusters", counted)
    got = {r.doc_id: r.n_links for r in spots.near_duplicates(frame(spark, rows)).collect()}
    assert met == [2] and got == {k: int(k in (0, 40)) for k in range(41)}  # not 41, all by the passage


def test_classes_of_null_ids_meet_their_own_texts_only(spark, monkeypatch):
    rows = [(None, prose(700 + k // 2, 60) + (" tail" if k % 2 else "")) for k in range(40)]
    met, join = [], near.class_texts

    def counted(texts, chosen):
        found = join(texts, chosen)
        met.append(found.count())
        return found

    monkeypatch.setattr(near, "class_texts", counted)
    got = near.near_links(frame(spark, rows)).collect()
    assert [r.n_links for r in got] == [1] * 40 and met == [40]  # not 40 x 40


def test_blocks_are_compared_in_passes(spark, monkeypatch):
    """Of a cluster of many blocks no more sets are sent at a time than there are."""
    rows, taken = families(), []
    plain = sorted(map(tuple, near.near_links(frame(spark, rows)).collect()), key=repr)
    monkeypatch.setattr(near, "PASS_SETS", 1)
    write = near.common.written

    def counted(df):
        out = write(df)
        if "whole" in out.columns:
            taken.append(out)
        return out

    monkeypatch.setattr(near.common, "written", counted)
    assert sorted(map(tuple, near.near_links(frame(spark, rows), block=2).collect()), key=repr) == plain
    assert len(taken) > 2


def test_counts_of_signatures_leave_single_ones_out(spark, monkeypatch):
    """Those of one text are counted, not written; parts and tasks add up."""
    monkeypatch.setattr(spots, "COUNTED", 60)
    monkeypatch.setattr(spots, "BUCKET_TEXTS", 3)
    rows = [(k, prose(k // 3, 50) + " " + prose(500 + k, 30)) for k in range(60)] + [(99, None), (98, "")]
    find, kept = spots.Signatures(), []
    want = Counter(s for _, t in rows for s in find((t or "").encode()).tolist())
    write = spots.common.written
    monkeypatch.setattr(spots.common, "written", lambda df: kept.append(write(df)) or kept[-1])
    names, n = spots.frequent(spots.common.id_text(frame(spark, rows).repartition(5)))
    assert dict(zip(names.tolist(), n.tolist())) == {s: k for s, k in want.items() if k > 1}
    held = kept[0].collect()
    assert all(r.n > 1 for r in held if r.signature >= 0) and sum(r.n for r in held if r.signature < 0) == want.total()
    assert [len(x) for x in spots.frequent(spots.common.id_text(frame(spark, []))) ] == [0, 0]


def test_length_partitions_neighbour():
    for threshold in (0.5, 0.8, 0.9):
        for n in range(1, 300):
            most = int(n / threshold + 1e-9)
            assert spots.length_partition(most, threshold) - spots.length_partition(n, threshold) in (0, 1)


def test_one_row_of_each_group_stays(spark):
    rows = families()
    out = near.one_of_each(frame(spark, rows))
    groups, _ = near_groups(rows)
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert len(kept) == len({tuple(g) for g in groups})
    for g in {tuple(g) for g in groups}:
        least = min(((rows[j][0] is None, rows[j][0] or 0) for j in g))
        assert sum((i is None, i or 0) == least and any(rows[j] == (i, t) for j in g) for i, t in kept) == 1
    assert set(out.columns) == set(frame(spark, rows).columns)


def test_pruning_bound_and_exact_counts():
    fewest = near.least_matches(0.8, 1e-7, range(16, 129, 16))
    assert list(fewest.values()) == sorted(fewest.values()) and 0 < fewest[128] < 102
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, 120)).astype(np.uint64) for _ in range(20)]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(20), np.arange(20)))
    want = [len(set(sets[a].tolist()) & set(sets[b].tolist())) for a, b in zip(i, j)]
    assert near._common(sets, sets, i, j).tolist() == want
    assert near._common(sets, sets, i[:5], j[:5]).tolist() == want[:5]
    assert near.class_of(near.shingles(b"a b c d e f")) == near.class_of(near.shingles(b"a  b c\nd e f"))
    assert shingle_set("") == set() and len(near.shingles(b"  ")) == 0


CLASHING = ("doc_id bigint not null, text string, row int not null, _row string not null, _cls bigint not null, _head_id bigint, "
            "id int not null, own int not null, head array<int> not null, kept struct<a: int not null> not null, spans int, n int")


def clashing(spark, rows):
    from pyspark.sql.types import StructType
    held = [(i, t, k, f"r{k}", k, None, k, k, [k], (k,), None, k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(held, StructType.fromDDL(CLASHING)).repartition(2)


def test_stages_keep_clashing_and_non_null_columns(spark):
    rows = [(i, t) for i, t in families() if i is not None]
    for f in (near.one_of_each, suffixes.without_repeats):
        docs = clashing(spark, rows)
        out = f(docs)
        assert out.columns == docs.columns
        want = {(r.doc_id, r.id): r for r in docs.collect()}
        found = out.collect()
        assert found and all(r[2:] == want[r.doc_id, r.id][2:] for r in found)
        assert f(clashing(spark, [])).collect() == []


@pytest.mark.parametrize("window,period", [(64, 8), (200, 24)])
def test_strings_that_occurred_before_go(spark, window, period):
    rows = [(i, t) for i, t in cases() + lopsided()]
    got = suffixes.repeated_spans(frame(spark, rows), window, shard_bytes=20_000, period=period, keep_first=True).collect()
    got = sorted(((r.doc_id, [tuple(s) for s in r.spans], bytes(r.kept)) for r in got), key=repr)
    want = [(i, spans, kept) for (i, _), (spans, kept) in zip(rows, again_bytes(rows, window))]
    assert got == sorted(want, key=repr)


def spot_set(t: str) -> set[int]:
    """SpotSigs signatures word by word, for texts of ASCII words."""
    import re
    ops = []
    for chunk in t.split():
        w = re.sub(r"[\W_]+", "", chunk.lower())
        if w or any(c.isalnum() for c in chunk):
            kind = 0 if w in spots._PASSED else 1 if w in spots._ANCHORS else 2
            ops.append((int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") & ~3 & (1 << 63) - 1 | kind, kind))
    mask = (1 << 64) - 1

    def chain(h, words):
        h = h * 0x9E3779B97F4A7C15 & mask
        for w in words:
            h = (h ^ w) * 0x9E3779B97F4A7C15 & mask
            h = (h ^ h >> 31) * 0xBF58476D1CE4E5B9 & mask
            h ^= h >> 29
        return h

    found, covered = set(), [False] * len(ops)
    for i, (h, kind) in enumerate(ops):
        after = [j for j in range(i + 1, len(ops)) if ops[j][1] == 2][:3]
        if kind == 1 and len(after) == 3:
            found.add(chain(h, [ops[j][0] for j in after]) >> 32)
            if after[-1] - i < spots.MOST_COVERED:
                for j in range(i, after[-1] + 1):
                    covered[j] = True
    runs = []
    for i in range(len(ops) - 3):
        if not any(covered[i:i + 4]):
            before = sum(covered[:i])
            if not runs or runs[-1][0] != before:
                runs.append((before, []))
            runs[-1][1].append(chain(ops[i][0], [ops[j][0] for j in range(i + 1, i + 4)]))
    for _, run in runs:
        for a in range(max(1, len(run) - spots.REACH + 1)):
            found.add(min(run[a:a + spots.REACH]) >> 32)
    if not found and ops:
        found.add(chain(ops[0][0], [h for h, _ in ops[:3]]) >> 32)
    return found


def test_signatures_word_by_word():
    find = spots.Signatures()
    texts = [prose(k, 5 + 13 * k) for k in range(25)] + ["the cat sat on the mat today", "one", "", "the of a", "a b c d", "x, y! z?"]
    texts += [" ".join(f"v{k * 7919 % 1009}q" for k in range(200)), "the " * 50 + "cat dog"]
    alone = [find(t.encode()) for t in texts]
    assert [set(a.tolist()) for a in alone] == [spot_set(t) for t in texts]
    together = find.of([find.hashed(spots.spaced(t.encode()).split()) for t in texts])
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(alone, together))


@pytest.mark.parametrize("earlier", [False, True])
def test_a_part_of_many_hashes_is_compared_in_little_memory(earlier):
    """Beside what it got and a byte for each hash, a part holds a step's arrays only."""
    parts, part, each, held = 8, 5, 150_000, 8
    rng = np.random.default_rng(6)
    low = np.uint64(part) << np.uint64(61)
    pool = rng.integers(0, 1 << 61, 4 * each, dtype=np.uint64) + low
    sent = [np.unique(rng.choice(pool, each, replace=False)) for _ in range(held)]
    again = [rng.random(len(x)) < 0.01 for x in sent]
    order = rng.permutation(held)
    table = pa.table({"part": pa.array([part] * held, pa.int32()), "shard": pa.array(order, pa.int32()),
                      "hashes": pa.array([sent[i].tobytes() for i in order], pa.binary()),
                      "again": pa.array([np.packbits(again[i]).tobytes() for i in order], pa.binary())})
    tracemalloc.start()
    out = shards.compared(part, table, parts, earlier, size=20_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * held * each  # half of the hashes' own size
    bits = dict(zip(out.column("shard").to_pylist(), out.column("bits").to_pylist()))
    for i in range(held):
        others = sent[:i] if earlier else sent[:i] + sent[i + 1:]
        want = np.isin(sent[i], np.concatenate(others)) if others else np.zeros(len(sent[i]), bool)
        got = np.unpackbits(np.frombuffer(bits[i], np.uint8), count=len(want)).astype(bool)
        assert (got == (want if earlier else want | again[i])).all()


def test_repeats_run_on_through_a_texts_pieces():
    assert suffixes.joined([], [(3, 9)]) == [(3, 9)]
    assert suffixes.joined([(0, 5)], [(5, 9), (12, 14)]) == [(0, 9), (12, 14)]
    assert suffixes.joined([(0, 5)], [(6, 9)]) == [(0, 5), (6, 9)]
