"""The queries of this subpackage and the SQL that states the same result."""

from __future__ import annotations

import functools

from .. import session
from . import decontamination, hardneg, langid, neardup, pii, quality, sentencepiece_fst, sharding, spelling, topk, toxicity, urlfilter, warc


def queries() -> dict:
    found = [langid.op1_language_id, quality.op2_quality, toxicity.op5_toxicity, pii.op8_pii, sharding.op10_sharding, warc.op9_warc, topk.op3_topk, decontamination.op4_decontamination, neardup.op6_neardup, sentencepiece_fst.op7_sentencepiece, hardneg.op11_hard_negatives, spelling.op12_spelling, urlfilter.op13_url_filters]
    return {f.__name__: shipped(f) for f in found}


def shipped(query):
    """query, after its package is sent to the executors."""

    @functools.wraps(query)
    def run(spark, sf_dir):
        session.ship(spark)
        return query(spark, sf_dir)

    return run


def oracle_sql() -> dict:
    return {"op8_pii": pii.op8_sql(), "op9_warc": warc.OP9_SQL, "op3_topk": topk.OP3_SQL, "op11_hard_negatives": hardneg.OP11_SQL, "op12_spelling": spelling.OP12_SQL, "op13_url_filters": urlfilter.op13_sql()}
