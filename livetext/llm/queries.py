"""The operators' queries and, where SQL can express them, their DuckDB equivalents."""

from livetext.llm.chat import OP2_SQL, op2_chat_format
from livetext.llm.cover_tree import op7_cover_tree
from livetext.llm.decontaminate import op4_decontamination
from livetext.llm.language import op3_language_crf
from livetext.llm.lexical import OP13_SQL, op13_lexical_search
from livetext.llm.packing import op9_best_fit_packing
from livetext.llm.pages import op8_main_text
from livetext.llm.pii import op10_pii_surrogates
from livetext.llm.simhash import op5_simhash
from livetext.llm.token_counts import op1_token_counts
from livetext.llm.toxicity import op6_toxicity
from livetext.llm.whitening import op12_whitening
from livetext.llm.word_table import op11_word_table

_OPERATORS = (
    op1_token_counts,
    op2_chat_format,
    op3_language_crf,
    op4_decontamination,
    op5_simhash,
    op6_toxicity,
    op7_cover_tree,
    op8_main_text,
    op9_best_fit_packing,
    op10_pii_surrogates,
    op11_word_table,
    op12_whitening,
    op13_lexical_search,
)
QUERIES = {f.__name__: f for f in _OPERATORS}
SQL = {"op2_chat_format": OP2_SQL, "op13_lexical_search": OP13_SQL}
