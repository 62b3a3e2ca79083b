"""The registered queries of this subpackage, with the SQL that checks them where SQL can."""

from __future__ import annotations

from sealgrade.llm.bpe import op8_bpe
from sealgrade.llm.decontamination import op1_decontamination
from sealgrade.llm.embedding_dedup import OP7_SQL, op7_embedding_dedup
from sealgrade.llm.filter_audit import OP11_SQL, op11_filter_audit
from sealgrade.llm.language_id import op3_language_id
from sealgrade.llm.lexical_search import OP13_SQL, op13_ranked_search
from sealgrade.llm.ngram_join import OP6_SQL, op6_ngram_jaccard_join
from sealgrade.llm.pieces import op12_sentencepiece
from sealgrade.llm.pii import op10_pii
from sealgrade.llm.substring_dedup import OP4_SQL, op4_substring_dedup
from sealgrade.llm.token_counts import OP2_SQL, op2_token_counts
from sealgrade.llm.token_files import op9_token_files
from sealgrade.llm.toxicity import op5_toxicity

QUERIES = {
    "op1_decontamination": (op1_decontamination, None),
    "op2_token_counts": (op2_token_counts, OP2_SQL),
    "op3_language_id": (op3_language_id, None),
    "op4_substring_dedup": (op4_substring_dedup, OP4_SQL),
    "op5_toxicity": (op5_toxicity, None),
    "op6_ngram_jaccard_join": (op6_ngram_jaccard_join, OP6_SQL),
    "op7_embedding_dedup": (op7_embedding_dedup, OP7_SQL),
    "op8_bpe": (op8_bpe, None),
    "op9_token_files": (op9_token_files, None),
    "op10_pii": (op10_pii, None),
    "op11_filter_audit": (op11_filter_audit, OP11_SQL),
    "op12_sentencepiece": (op12_sentencepiece, None),
    "op13_ranked_search": (op13_ranked_search, OP13_SQL),
}
