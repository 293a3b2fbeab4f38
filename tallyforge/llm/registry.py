"""The queries of the training-data operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from tallyforge.llm import decontamination, fingerprints, hard_negatives, html_text, language, mixing, near_dedup, quality, secrets, token_alignment, token_files, toxicity, urls


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_tokens": token_files.op3_tokens,
    "op4_language": language.op4_language,
    "op5_decontaminate": decontamination.op5_decontaminate,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_urls": urls.op7_urls,
    "op8_html": html_text.op8_html,
    "op9_secrets": secrets.op9_secrets,
    "op10_fingerprint": fingerprints.op10_fingerprint,
    "op11_token_alignment": token_alignment.op11_token_alignment,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_quality": quality.op13_quality,
    "pipeline": pipeline,
}
ORACLE_SQL = {"op1_mix": mixing.OP1_SQL, "op12_hard_negatives": hard_negatives.OP12_SQL}
