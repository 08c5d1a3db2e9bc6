"""The training-data queries by name, with their SQL where there is one."""

from . import alignment, chat, decontaminate, fixity, hmm, html_text, jaccard, licenses, mixing, neighbours, resampling, sharding, toxicity

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_warc_fixity": fixity.op3_warc_fixity,
    "op4_benchmark_decontamination": decontaminate.op4_benchmark_decontamination,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_ngram_jaccard": jaccard.op6_ngram_jaccard,
    "op7_html_extraction": html_text.op7_html_extraction,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_nn_descent": neighbours.op9_nn_descent,
    "op10_hmm_language_model": hmm.op10_hmm_language_model,
    "op11_tokenizer_alignment": alignment.op11_tokenizer_alignment,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_hilbert_sharding": sharding.op13_hilbert_sharding,
}
SQL = {k: v for m in (alignment, chat, decontaminate, fixity, hmm, html_text, jaccard, licenses, mixing, neighbours, resampling, sharding, toxicity) for k, v in m.SQL.items()}
