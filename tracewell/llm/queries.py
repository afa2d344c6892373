"""The numbered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from tracewell.llm import alignment, decontamination, fingerprints, mixing, near_duplicates, neighbours, packing, pages, phrases, repeats, token_store, toxicity, transcripts

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_posting_lists": neighbours.op2_posting_lists,
    "op3_minhash_near_dedup": near_duplicates.op3_minhash_near_dedup,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_transcript_roles": transcripts.op7_transcript_roles,
    "op8_host_suffix_extraction": pages.op8_host_suffix_extraction,
    "op9_suffix_array_dedup": repeats.op9_suffix_array_dedup,
    "op10_token_store": token_store.op10_token_store,
    "op11_benchmark_decontamination": decontamination.op11_benchmark_decontamination,
    "op12_tokenizer_alignment": alignment.op12_tokenizer_alignment,
    "op13_phrase_collocations": phrases.op13_phrase_collocations,
}

ORACLES = {
    "op1_fingerprints": fingerprints.ORACLE,
    "op4_mix_sources": mixing.ORACLE,
    "op9_suffix_array_dedup": repeats.ORACLE,
    "op11_benchmark_decontamination": decontamination.ORACLE,
    "op13_phrase_collocations": phrases.ORACLE,
}
