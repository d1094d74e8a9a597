"""Queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from inkmesh.llm import align, chat, decontaminate, lm, neardup, packing, quality, resample, sharding, suffix, urls, votes, warc

QUERIES = {
    f.__name__: f
    for f in (
        quality.op1_quality_rules,
        chat.op2_chat_format,
        urls.op3_url_filter,
        decontaminate.op4_decontaminate,
        warc.op5_warc_derivatives,
        neardup.op6_near_dedup,
        lm.op7_lm_score,
        sharding.op8_sharding,
        suffix.op9_suffix_dedup,
        packing.op10_best_fit_packing,
        resample.op11_resample,
        align.op12_align,
        votes.op13_quality_votes,
        quality.quality_ablations,
    )
}
ORACLE_SQL = {"op1_quality_rules": quality.OP1_SQL, "quality_ablations": quality.ABLATIONS_SQL, "op2_chat_format": chat.OP2_SQL, "op3_url_filter": urls.OP3_SQL, "op5_warc_derivatives": warc.OP5_SQL, "op6_near_dedup": neardup.OP6_SQL, "op4_decontaminate": decontaminate.OP4_SQL, "op9_suffix_dedup": suffix.OP9_SQL, "op11_resample": resample.OP11_SQL}
