"""Toxicity, language ID, top-k search."""
import random

import numpy as np
import pytest
from llm_cases import cases, frame, prose, prepared  # noqa: F401

from capgraph.llm import op4_exact_topk as topk
from capgraph.llm import op7_language as language
from capgraph.llm import op9_toxicity as toxicity

SYLLABLES = {"en": "the and ing ther tion", "fr": "le eau ou ment que", "de": "der sch und ich keit"}
BAD = ["vileword", "scumbag", "hatefull"]


def spoken(lang, seed, words=60):
    rng = random.Random(f"{lang}{seed}")
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choices(parts, k=rng.randrange(1, 3))) for _ in range(words))


def toxic_docs(spark, n=240):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(n):
        words, bad = prose(1000 + k, 60).split(), k % 5 == 0
        for _ in range(3 * bad):
            words.insert(rng.randrange(60), rng.choice(BAD).upper())
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    return frame(spark, rows), spark.createDataFrame(labels + [(5000, 1), (7, None)], "doc_id bigint, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_docs(spark)
    model = toxicity.learned(docs, labels)
    rows = (toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out(toxicity.F.col("doc_id")))
            .where("toxic IS NOT NULL").collect())
    assert len(rows) > 40
    right = sum((r.score >= toxicity.THRESHOLD) == bool(r.toxic) for r in rows)
    assert right >= 0.95 * len(rows)
    kept = toxicity.clean_rows(docs, model)
    assert kept.columns == docs.columns and 0.7 * 240 < kept.count() < 0.9 * 240


def test_toxicity_scores_every_odd_row(spark):
    docs, labels = toxic_docs(spark, 60)
    model = toxicity.learned(docs, labels)
    rows = toxicity.score(frame(spark), model).collect()
    assert len(rows) == len(cases()) and all(0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if r.doc_id in (20, 21)}
    assert len(empty) == 1
    assert toxicity.score(frame(spark, []), model).count() == 0
    one = spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")
    only = toxicity.train(docs, one)
    assert not only.kept.any() and only.score(np.array([3], np.int32)) > 0.9
    none = toxicity.train(docs, one.limit(0))
    assert none.score(np.zeros(0, np.int32)) < 0.1


def test_features_of_long_texts_are_read_in_parts(monkeypatch):
    body = prose(5, 400).encode()
    whole = toxicity.Features()(body)
    monkeypatch.setattr(toxicity, "PART", 64)
    assert (toxicity.Features()(body) == whole).all()


def test_training_sample_is_bounded_and_the_same(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)] + [(4, 1), (4, 0), (None, 1)], "doc_id bigint, toxic int")
    a = toxicity.training_sample(labels, 10).collect()
    b = toxicity.training_sample(labels.repartition(7), 10).collect()
    assert sorted(a) == sorted(b) and len(a) == 20


def test_language_on_held_out_rows(spark):
    rows = [(k, spoken(lang, k), lang) for k, lang in enumerate(["en", "fr", "de"] * 40)]
    docs = spark.createDataFrame(rows + [(900, "x", None)], "doc_id bigint, text string, lang string")
    found = language.learned(docs)
    assert sorted(found) == ["de", "en", "fr"] and all(len(d) <= language.DICTIONARY_BYTES for d in found.values())
    got = (language.predict(docs, found).join(docs, "doc_id").where(language.held_out(language.F.col("doc_id")))
           .where("lang IS NOT NULL").collect())
    assert len(got) > 10 and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def test_languages_are_learned_from_whole_texts(spark):
    opening = " ".join(f"licence{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400))
    rows = [(k, f"{opening} {spoken(lang, k, 200)}", lang) for k, lang in enumerate(["en", "fr", "de"] * 60)]
    rows += [(1000 + k, spoken("en", 1, 200), "en") for k in range(90)]
    found = language.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), dictionary_bytes=40_000)
    for lang, held in found.items():
        assert len(held) == 40_000 and held.count(b"licencefa") <= 3  # where a piece begins or ends
        assert held.count(b"licenceab") <= 3
    docs = spark.createDataFrame([(k, spoken(lang, 500 + k, 60)) for k, lang in enumerate(["en", "fr", "de"] * 10)],
                                 "doc_id bigint, text string")
    got = language.predict(docs, found).collect()
    assert all(r.lang_pred == ["en", "fr", "de"][r.doc_id % 3] for r in got)


def test_learning_rows_are_bounded_and_filled(spark):
    rows = [(None, spoken("en", k, 400), "en") for k in range(50)] + [(7, spoken("fr", 7, 4000), "fr"), (8, "12 34", "xx")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert language.sampled_rows(docs, "lang", "doc_id", "text", 10).where("lang = 'en'").count() == 1
    found = language.learn(docs, dictionary_bytes=4000)
    again = language.learn(docs.repartition(7), dictionary_bytes=4000)
    assert sorted(found) == ["en", "fr"] and found == again and len(found["fr"]) == 4000
    assert language.learning_pieces("漢" * 1000) and max(map(len, language.learning_pieces("é" * 5000 + " a"))) <= 520


def test_language_of_odd_rows(spark):
    found = {lang: spoken(lang, 1, 3000).encode() for lang in SYLLABLES}
    rows = language.predict(frame(spark), found).collect()
    assert len(rows) == len(cases())
    for r in rows:
        if r.doc_id in (20, 21, 22):
            assert (r.lang_pred, r.score, r.reliable) == ("und", 0.0, False)
        else:
            assert r.lang_pred in SYLLABLES or r.doc_id is None
    assert {r.lang_pred for r in language.predict(frame(spark), {}).collect()} == {"und"}
    assert language.learn(frame(spark, [])) == {}
    kept = language.reliable_rows(frame(spark), found)
    assert kept.columns == frame(spark).columns and not kept.where("doc_id IN (20, 21, 22)").count()


def test_pieces_keep_characters_whole():
    body = ("é漢🙂a" * 900).encode()
    parts = [body[a:b] for a, b in language.piece_ends(body, 100)]
    assert b"".join(parts) == body
    for p in parts:
        p.decode()


def brute_top(rows, asked, k, scale=1024):
    fine = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in fine:
        if asked(q):
            near = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q and len(w) == len(v))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 2.0])
def test_top_k_matches_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "BUCKET", 64)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 12))
    rows = []
    for k in range(400):
        v = centres[k % 6] + rng.normal(size=12) * 0.2
        v *= np.exp(spread * rng.normal()) / np.linalg.norm(v)
        rows.append((k, v.astype(np.float32).tolist()))
    rows += [(1000, rows[7][1]), (1001, rows[7][1]), (1002, None), (1003, []), (1004, [0.0] * 12), (1005, [None] + [1.0] * 11),
             (1006, [float("nan")] * 12), (1007, [float("inf")] * 12), (None, [1.0] * 12), (1010, [1.0, 2.0]), (1020, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5)
    got = topk.top_k(df, df.where("vec_id % 10 = 0"), k=7).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(rows, lambda q: q % 10 == 0, 7)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_large_components_stay_exact(spark):
    rows = [(0, [float(1 << 30), 1.0]), (1, [float(1 << 30), 3.0]), (2, [float(1 << 30), 2.0]), (3, [-1.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = topk.top_k(df, df, k=3, scale=1).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(rows, lambda q: True, 3, 1)


def test_toxicity_fit_is_the_fit_in_one_place(spark):
    """The Spark fit against one over plain arrays of the same rows."""
    docs, labels = toxic_docs(spark, 120)
    model = toxicity.train(docs, labels)
    wanted = {r.doc_id: r.toxic for r in labels.where("toxic IS NOT NULL").collect()}
    find = toxicity.Features()
    rows = [(wanted[r.doc_id], find(r.text.encode())) for r in docs.collect() if r.doc_id in wanted]
    y = np.array([a for a, _ in rows])
    x = np.zeros((len(rows), 1 << toxicity.BITS), bool)
    for i, (_, found) in enumerate(rows):
        x[i, found] = True
    toxic, clean = x[y == 1].sum(axis=0) + 1.0, x[y == 0].sum(axis=0) + 1.0
    n1, n0 = (y == 1).sum() + 2, (y == 0).sum() + 2
    ratio = np.log(toxic / n1) - np.log(clean / n0)
    kept = np.flatnonzero(np.abs(ratio) >= toxicity.LEAST_Z * np.sqrt(1 / toxic - 1 / n1 + 1 / clean - 1 / n0))
    assert model.places.tolist() == kept.tolist() and len(kept) > 5
    f = x[:, kept] * ratio[kept] / np.sqrt(np.maximum(1, x[:, kept].sum(axis=1)))[:, None]
    has = x[:, kept].any(axis=1)
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * has
    w, bias, m, v = np.zeros(len(kept)), 0.0, np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
    for k in range(1, toxicity.STEPS + 1):
        g = (1 / (1 + np.exp(-(f @ w + bias))) - y) * share
        g = np.append(f.T @ g + toxicity.RIDGE * w, g.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = toxicity.RATE * m / (1 - 0.9 ** k) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    assert np.allclose(model.weights, w * ratio[kept], atol=1e-6) and abs(model.bias - bias) < 1e-6


def test_language_is_the_least_of_plain_compressions(spark):
    import zstandard
    found = {lang: spoken(lang, 1, 2000).encode() for lang in SYLLABLES}
    rows = [(k, spoken(lang, 300 + k, 40)) for k, lang in enumerate(sorted(SYLLABLES) * 5)]
    got = {r.doc_id: r.lang_pred for r in language.predict(frame(spark, rows), found).collect()}
    for k, t in rows:
        body = language.letters(t).encode()
        assert len(body) < language.PIECE_BYTES
        size = {lang: len(zstandard.ZstdCompressor(level=language.LEVEL, write_content_size=False, write_dict_id=False,
                          dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(body))
                for lang, d in found.items()}
        assert size[got[k]] == min(size.values())


def test_topk_of_large_components_is_the_sql(spark):
    import duckdb

    from capgraph.llm import oracle
    tiny = 2.0 ** -10  # 1 when scaled, so that products with 2^53 fit the SQL's 64 bits
    rows = [(0, [tiny, -tiny]), (100, [3 * tiny, tiny]), (1, [float(1 << 43), 1.0]), (2, [-float(1 << 43), 2.0]), (3, [float(1 << 30), 3.0]),
            (4, [float(1 << 60), 1.0]), (5, [float("nan"), 1.0])] + [(10 + k, [k / 7, -k / 3]) for k in range(30)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"),
                     spark.createDataFrame(rows[:2], "vec_id bigint, embedding array<double>")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [r for r in rows if r[0] != 4])  # 2^60 * 1024 is no BIGINT
    assert sorted(map(tuple, got)) == sorted(con.execute(oracle.TOP_K).fetchall()) and any(r.vec_id == 1 for r in got)
