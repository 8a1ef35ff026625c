"""The subpackage's queries and their SQL, as __spark_entry__ registers them."""

from vireo.llm import decontaminate, divergence, htmltext, licenses, linededup, lmscore, merkle, neardup, packing, quality, sharding, toxicity, warc

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_cgk_decontaminate": decontaminate.op2_cgk_decontaminate,
    "op3_hilbert_shards": sharding.op3_hilbert_shards,
    "op4_chosen_path": neardup.op4_chosen_path,
    "op5_attention_lm": lmscore.op5_attention_lm,
    "op6_warc_segments": warc.op6_warc_segments,
    "op7_best_fit": packing.op7_best_fit,
    "op8_quality": quality.op8_quality,
    "op9_fuzzy_lines": linededup.op9_fuzzy_lines,
    "op10_block_labeller": htmltext.op10_block_labeller,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_divergence": divergence.op13_divergence,
}

ORACLE_SQL = {
    "op1_license_scan": licenses.oracle_sql(),
    "op6_warc_segments": warc.ORACLE,
    "op8_quality": quality.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op13_divergence": divergence.ORACLE,
}
