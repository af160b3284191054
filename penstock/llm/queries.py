"""The registered queries of this subpackage and their SQL checks."""

from penstock.llm.decontaminate import OP10_SQL, op10_decontaminate
from penstock.llm.html import op4_html_text
from penstock.llm.licenses import OP6_SQL, op6_license_scan
from penstock.llm.lm import op7_lm_scores
from penstock.llm.mixing import OP3_SQL, op3_source_mix
from penstock.llm.neighbours import op13_embedding_dedup
from penstock.llm.pii import op8_pseudonyms
from penstock.llm.repair import OP12_SQL, op12_conversation_repair
from penstock.llm.simhash import op5_simhash
from penstock.llm.substrings import op1_substring_dedup
from penstock.llm.topk import OP9_SQL, op9_exact_top_k
from penstock.llm.toxicity import op2_toxicity
from penstock.llm.whitening import op11_whitening

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_source_mix": op3_source_mix,
    "op4_html_text": op4_html_text,
    "op5_simhash": op5_simhash,
    "op6_license_scan": op6_license_scan,
    "op7_lm_scores": op7_lm_scores,
    "op8_pseudonyms": op8_pseudonyms,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_decontaminate": op10_decontaminate,
    "op11_whitening": op11_whitening,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_embedding_dedup": op13_embedding_dedup,
}

ORACLE = {
    "op3_source_mix": OP3_SQL,
    "op6_license_scan": OP6_SQL,
    "op9_exact_top_k": OP9_SQL,
    "op10_decontaminate": OP10_SQL,
    "op12_conversation_repair": OP12_SQL,
}
