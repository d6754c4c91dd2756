"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet in the shared folder and read again as the next stage's
``docs``.  All but the last return the columns of ``documents``:

1. toxicity: documents that score 0.7 or more go;
2. language: documents without a language told reliably go;
3. near_duplicates: of each group of texts linked by a 5-word-shingle likeness
   of 0.8 or more the document with the least id stays;
4. repeated_text: strings of 200 bytes that occurred before are cut out, so the
   first of a passage's copies stays;
5. packing: whole documents into sequences of 4096 tokens.

Each stage learns from, and judges, what the one before it kept.
"""

from __future__ import annotations

from capgraph.llm import common, op3_packing, op6_suffix_dedup, op7_language, op9_toxicity, op10_ngram_join, tokenizer


#: A passage of 50 words has 250 bytes or more; phrases are cut so that eight lie in a window.
PASSAGE_BYTES, PASSAGE_PERIOD = 200, 24


def toxicity(spark, docs, sf_dir):
    common.prepare(spark)
    return op9_toxicity.clean_rows(docs, op9_toxicity.learned(docs, common.table(spark, sf_dir, "labels")))


def language(spark, docs, sf_dir):
    common.prepare(spark)
    return op7_language.reliable_rows(docs, op7_language.learned(docs))


def near_duplicates(spark, docs, sf_dir):
    common.prepare(spark)
    return op10_ngram_join.one_of_each(docs)


def repeated_text(spark, docs, sf_dir):
    common.prepare(spark)
    return op6_suffix_dedup.without_repeats(docs, PASSAGE_BYTES, period=PASSAGE_PERIOD, keep_first=True)


def packing(spark, docs, sf_dir):
    common.prepare(spark)
    return op3_packing.pack_documents(docs, tokenizer.default_path())


STAGES = [("toxicity", toxicity), ("language", language), ("near_duplicates", near_duplicates),
          ("repeated_text", repeated_text), ("packing", packing)]

#: SQL can express neither the classifiers nor the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    common.prepare(spark)
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
