"""Tokenizer memo, token counts, packing, SentencePiece."""
import math
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import cases, frame, text, prepared  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from capgraph.llm import op2_sentencepiece as sp
from capgraph.llm import op3_packing as packing
from capgraph.llm import op5_token_counts as counts
from capgraph.llm import tokenizer

PATH = tokenizer.default_path()
LIBRARY = Tokenizer.from_file(PATH)
WORDS = tokenizer.load(PATH)
PIECES = sp.load(tokenizer.default_path(sp.FILE))


def library_ids(t):
    return LIBRARY.encode(text(t), add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]),
                                  st.sampled_from(" \n\t'.,!aAeEtTsSéÉßÿÀñ<|>endoftext0123")), max_size=60))
def test_word_memo_gives_the_librarys_ids(t):
    got = WORDS.ids_of(t.encode())
    assert list(struct.unpack(f"<{len(got) // 4}I", got)) == library_ids(t)
    assert WORDS.counts_of([t.encode()]) == [len(library_ids(t))]


def test_memo_is_bounded():
    memo = tokenizer.Memo(len, limit=10)
    assert [memo["x" * k] for k in range(100)] == list(range(100))
    assert len(memo) <= 10 and len(memo.old) <= 10


def test_segments_cut_only_at_space():
    body = (b"abc " * 50 + b"x" * 300 + b" yz\n" + b"q" * 90)
    parts = counts.segments(body, 40)
    assert b"".join(parts) == body and max(map(len, parts)) <= 341
    assert [w for p in parts for w in p.split()] == body.split()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_match_the_library(spark, name):
    path = tokenizer.default_path(name)
    rows = counts.token_counts(frame(spark), path, limit=100, batch_bytes=700, segment_bytes=64).collect()
    if name.endswith(".model"):
        import sentencepiece
        encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
    else:
        t = Tokenizer.from_file(path)
        encode = lambda x: t.encode(x, add_special_tokens=False).ids
    want = [(i, len(text(t).encode()), len(encode(text(t)))) for i, t in cases()]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in rows), key=repr) == sorted(want, key=repr)
    assert all(r.over_limit == (r.n_tokens > 100) for r in rows)


def test_packing_is_whole_and_gapless(spark):
    rows = packing.pack_documents(frame(spark), PATH, sequence=128, open_bins=16).collect()
    pieces = sorted(((r.doc_id, r.length, r.ids_crc32) for r in rows), key=repr)
    want = []
    for i, t in cases():
        ids = library_ids(t) + [1]
        for at in range(0, len(ids), 128):
            part = ids[at:at + 128]
            want.append((i, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert pieces == sorted(want, key=repr)
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        assert [o for o, _ in sorted(held)] == list(np.cumsum([0] + [n for _, n in sorted(held)])[:-1])
        assert sum(n for _, n in held) <= 128
    assert len(bins) <= math.ceil(sum(r.length for r in rows) / 128) + 2


def brute_best_fit(lengths, size, open_bins):
    free, places = [], []
    for n in lengths:
        fits = [b for b in free if b[0] >= n]
        if fits:
            b = min(fits, key=lambda b: b[0])
        else:
            if n < size and len(free) == open_bins:
                free.remove(min(free, key=lambda b: b[0]))
            b = [size]
            free.append(b)
        places.append((size - b[0]))
        b[0] -= n
        if b[0] == 0:
            free.remove(b)
    return places


def test_packer_is_best_fit_and_closes_the_fullest():
    rng = random.Random(5)
    for bins in (1, 3, 50):
        lengths = [rng.randrange(1, 101) for _ in range(600)]
        packer = packing.Packer(100, bins)
        assert [packer.put(n)[1] for n in lengths] == brute_best_fit(lengths, 100, bins)


def test_packing_and_counts_of_an_empty_table(spark):
    empty = frame(spark, [])
    assert packing.pack_documents(empty, PATH).count() == 0
    assert counts.token_counts(empty, PATH, 10).count() == 0
    assert sp.encode(empty, tokenizer.default_path(sp.FILE)).count() == 0


def whole(t):
    marked = sp.normalised(text(t).encode("utf-8", "replace"))
    _, back = PIECES.trace(marked, len(marked), [0])
    return PIECES.walk(marked, back, len(marked))[1]


def by_chunks(t, size):
    marked = sp.normalised(t.encode())
    chunks = [sp.Chunk(PIECES, marked[a:a + size + PIECES.longest - 1], min(size, len(marked) - a))
              for a in range(0, len(marked), size)]
    n = PIECES.longest
    entries = [[0] + [sp.LOW] * (n - 1)] + [m[0].tolist() for m in sp.scan([c.matrix() for c in chunks])[:-1]]
    state, out = 0, []
    for starts, head, tails in reversed([c.variants(e) for c, e in zip(chunks, entries)]):
        out.append(head + tails[state])
        state = starts[state]
    return np.frombuffer(b"".join(reversed(out)), "<u4").tolist()


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="ab theiñ▁ \n漢🙂", min_size=1, max_size=150), st.integers(3, 70))
def test_scan_over_chunks_is_the_sequential_best_path(t, size):
    assert by_chunks(t, size) == whole(t)
    assert np.frombuffer(PIECES.plain(sp.normalised(t.encode())), "<u4").tolist() == whole(t)


def test_max_plus_product_is_associative():
    rng = np.random.default_rng(2)
    a, b, c = (np.where(rng.random((6, 6)) < 0.3, sp.LOW, rng.integers(-50, 0, (6, 6))) for _ in range(3))
    left, right = sp.product(sp.product(a, b), c), sp.product(a, sp.product(b, c))
    assert (left == right).all()
    steps = sp.scan([a, b, c, a, b])
    assert (steps[4] == sp.product(sp.product(sp.product(sp.product(a, b), c), a), b)).all()


def test_best_path_is_no_worse_than_the_librarys_lattice():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb
    model = pb.ModelProto()
    with open(tokenizer.default_path(sp.FILE), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    words = sorted({w for _, t in cases() for w in text(t).split() if PIECES.known.issuperset(w)})[:300]
    same = 0
    for w in words:
        mine, theirs = whole(w), library.nbest_encode(w, nbest_size=1, out_type=int)[0]
        assert PIECES.score_of[mine].sum() >= PIECES.score_of[theirs].sum()
        same += mine == theirs
    assert same > 0.9 * len(words)


def test_encoding_on_spark_round_trips(spark):
    path = tokenizer.default_path(sp.FILE)
    rows = sp.decode(sp.encode(frame(spark), path, chunk_chars=500), path).collect()
    got = sorted(((r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist(), bytes(r.body).decode()) for r in rows), key=repr)
    assert got == sorted(((i, whole(t), text(t)) for i, t in cases()), key=repr)


def test_equal_rows_are_packed_by_several_tasks(spark):
    rows = [(None, "the same words again")] * 3000
    out = packing.pack_documents(frame(spark, rows), PATH, sequence=64, open_bins=16, shard_pieces=500)
    found = out.withColumn("task", F.spark_partition_id()).collect()
    assert len(found) == 3000 and len({r.task for r in found}) >= 4
    assert max(sum(r.task == t for r in found) for t in {r.task for r in found}) < 1600
    held: dict[int, list] = {}
    for r in found:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all([o for o, _ in sorted(h)] == list(np.cumsum([0] + [n for _, n in sorted(h)])[:-1]) for h in held.values())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab theiñ▁\n\t漢🙂\x00é.", max_size=70), min_size=1, max_size=40))
def test_words_learned_together_have_the_best_paths(words):
    pieces = PIECES
    pieces.memo.clear()
    pieces.memo.old = {}
    words = [w for w in words if " " not in w and sp.MARK not in w]
    pieces.learn(words)
    held = dict(pieces.memo)
    assert set(held) == {w for w in words if len(w) < sp.LONG_WORD}
    assert all(ids == pieces._best(sp.MARK + w) for w, ids in held.items())
