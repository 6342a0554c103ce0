"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from ballotlake.llm.chat import OP13_SQL, op13_chat_formatting
from ballotlake.llm.decontaminate import op4_decontamination
from ballotlake.llm.infill import OP12_SQL, op12_fill_in_middle
from ballotlake.llm.lines import OP2_SQL, op2_line_dedup
from ballotlake.llm.pages import op3_html_extraction
from ballotlake.llm.pieces_codec import op7_sentencepiece
from ballotlake.llm.pseudo_likelihood import op1_lm_scoring
from ballotlake.llm.quality import op9_quality_classifier
from ballotlake.llm.ranked import OP11_SQL, op11_ranked_search
from ballotlake.llm.repetition import op8_quality_rules
from ballotlake.llm.simhash import op6_simhash_near_dedup
from ballotlake.llm.substrings import op5_suffix_array_dedup
from ballotlake.llm.toxicity import op10_toxicity

QUERIES = {f.__name__: f for f in (
    op1_lm_scoring,
    op2_line_dedup,
    op3_html_extraction,
    op4_decontamination,
    op5_suffix_array_dedup,
    op6_simhash_near_dedup,
    op7_sentencepiece,
    op8_quality_rules,
    op9_quality_classifier,
    op10_toxicity,
    op11_ranked_search,
    op12_fill_in_middle,
    op13_chat_formatting,
)}

ORACLE: dict[str, str] = {
    "op2_line_dedup": OP2_SQL,
    "op11_ranked_search": OP11_SQL,
    "op12_fill_in_middle": OP12_SQL,
    "op13_chat_formatting": OP13_SQL,
}
