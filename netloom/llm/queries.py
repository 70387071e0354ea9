"""The subpackage's queries and their SQL; the pipeline registers itself."""

from __future__ import annotations

from netloom.llm import fm_index, ngram_join, quality_rules, source_mixing
from netloom.llm.bpe import op5_bpe
from netloom.llm.conversations import op11_conversation_repair
from netloom.llm.fm_index import op13_fm_decontam
from netloom.llm.html_main import op7_html_main
from netloom.llm.ngram_join import op10_ngram_join
from netloom.llm.quality_rules import op6_quality_rules
from netloom.llm.source_mixing import op9_source_mixing
from netloom.llm.spelling import op12_spelling_variants
from netloom.llm.suffix_dedup import op4_suffix_dedup
from netloom.llm.telephony import op8_media_columns
from netloom.llm.token_binary import op3_token_binary
from netloom.llm.token_rollup import op2_token_rollup
from netloom.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_rollup": op2_token_rollup,
    "op3_token_binary": op3_token_binary,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_bpe": op5_bpe,
    "op6_quality_rules": op6_quality_rules,
    "op7_html_main": op7_html_main,
    "op8_media_columns": op8_media_columns,
    "op9_source_mixing": op9_source_mixing,
    "op10_ngram_join": op10_ngram_join,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_fm_decontam": op13_fm_decontam,
}
ORACLE_SQL = {
    "op6_quality_rules": quality_rules.oracle(),
    "op9_source_mixing": source_mixing.oracle(),
    "op10_ngram_join": ngram_join.ORACLE,
    "op13_fm_decontam": fm_index.ORACLE,
}
