"""The queries of this subpackage and their SQL."""

from siteatlas.llm.alignment import op13_tokenizer_alignment
from siteatlas.llm.divergence import OP11_SQL, op11_source_divergence
from siteatlas.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from siteatlas.llm.extraction import op1_html_extraction
from siteatlas.llm.imatch import op4_imatch
from siteatlas.llm.jaccard_join import op7_jaccard_join
from siteatlas.llm.kneser_ney import op6_kneser_ney
from siteatlas.llm.mixing import OP8_SQL, op8_mix_sources
from siteatlas.llm.nearest import OP12_SQL, op12_exact_top_k
from siteatlas.llm.packing import op9_best_fit_packing
from siteatlas.llm.secrets import OP2_SQL, op2_secret_scan
from siteatlas.llm.substrings import op10_suffix_dedup
from siteatlas.llm.toxicity import op5_toxicity

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_secret_scan": op2_secret_scan,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_imatch": op4_imatch,
    "op5_toxicity": op5_toxicity,
    "op6_kneser_ney": op6_kneser_ney,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_mix_sources": op8_mix_sources,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_exact_top_k": op12_exact_top_k,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}
SQL = {"op2_secret_scan": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op8_mix_sources": OP8_SQL, "op11_source_divergence": OP11_SQL, "op12_exact_top_k": OP12_SQL}
