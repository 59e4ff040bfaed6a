"""The queries of the training-data operators, one per operator, and their SQL."""

from __future__ import annotations

from cairn.llm.align import op12_alignment
from cairn.llm.brown import op11_class_lm
from cairn.llm.ctph import op2_ctph
from cairn.llm.decontam import SQL as OP8_SQL
from cairn.llm.decontam import op8_decontamination
from cairn.llm.hilbert import op6_hilbert_shards
from cairn.llm.langid import op3_language_id
from cairn.llm.lines import op1_line_dedup
from cairn.llm.packing import op9_packing
from cairn.llm.quality import op7_quality
from cairn.llm.ranked import SQL as OP13_SQL
from cairn.llm.ranked import op13_ranked
from cairn.llm.repeats import op10_repeats
from cairn.llm.secrets import op4_secrets
from cairn.llm.simhash import op5_simhash

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_ctph, op3_language_id, op4_secrets, op5_simhash, op6_hilbert_shards, op7_quality, op8_decontamination, op9_packing, op10_repeats, op11_class_lm, op12_alignment, op13_ranked)}
SQL: dict[str, str] = {"op8_decontamination": OP8_SQL, "op13_ranked": OP13_SQL}
