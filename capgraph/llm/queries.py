"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import oracle
from .common import prepare
from .op10_ngram_join import op10_ngram_join
from .op11_merkle import op11_merkle
from .op12_ranked_search import op12_ranked_search
from .op13_sharding import op13_sharding
from .op1_fingerprints import op1_fingerprints, spotsigs_near_duplicates
from .op2_sentencepiece import op2_sentencepiece
from .op3_packing import op3_packing
from .op4_exact_topk import op4_exact_topk
from .op5_token_counts import op5_token_counts
from .op6_suffix_dedup import op6_suffix_dedup
from .op7_language import op7_language
from .op8_substring_dedup import op8_substring_dedup
from .op9_toxicity import op9_toxicity

QUERIES = {f.__name__: f for f in (
    op1_fingerprints, op2_sentencepiece, op3_packing, op4_exact_topk, op5_token_counts, op6_suffix_dedup, op7_language,
    op8_substring_dedup, op9_toxicity, op10_ngram_join, op11_merkle, op12_ranked_search, op13_sharding,
    spotsigs_near_duplicates,
)}
#: The others need a tokenizer, a trained model or bytes that SQL can't cut; the
#: tests hold them against brute force or held-out rows.
ORACLE = {"op4_exact_topk": oracle.TOP_K, "op8_substring_dedup": oracle.SUBSTRINGS, "op10_ngram_join": oracle.NEAR,
          "op11_merkle": oracle.MERKLE, "op12_ranked_search": oracle.RANKED, "op13_sharding": oracle.SHARDS}


def _prepared(fn):
    def run(spark, sf_dir):
        prepare(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def queries():
    return {name: _prepared(fn) for name, fn in QUERIES.items()}


def oracle_sql():
    return dict(ORACLE)
