"""Registered queries of the operators in this folder, and SQL where it can express them."""

import corpus_pipeline

from .chat_format import OP6_SQL, op6_chat_format
from .decontaminate import op7_decontaminate
from .language_id import op3_language_id
from .line_templates import op8_line_templates
from .minhash_dedup import op4_minhash_dedup
from .ngram_lm import op9_ngram_lm
from .packing import op10_packing
from .periodic_runs import OP12_SQL, op12_periodic_runs
from .private_data import op11_private_data
from .quality_rules import op2_quality_rules
from .spelling_variants import OP13_SQL, op13_spelling_variants
from .suffix_dedup import op1_suffix_dedup
from .warc_zip import op5_warc_zip

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_language_id": op3_language_id,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_warc_zip": op5_warc_zip,
    "op6_chat_format": op6_chat_format,
    "op7_decontaminate": op7_decontaminate,
    "op8_line_templates": op8_line_templates,
    "op9_ngram_lm": op9_ngram_lm,
    "op10_packing": op10_packing,
    "op11_private_data": op11_private_data,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_spelling_variants": op13_spelling_variants,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op6_chat_format": OP6_SQL,
    "op12_periodic_runs": OP12_SQL,
    "op13_spelling_variants": OP13_SQL,
}
