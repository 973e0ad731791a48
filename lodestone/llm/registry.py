"""The queries of this subpackage, and SQL for those that SQL can express."""

from lodestone.llm import decontaminate, quality_rules
from lodestone.llm.decontaminate import op3_benchmark_decontamination
from lodestone.llm.html_text import op1_html_extraction
from lodestone.llm.language_model import op10_lm_scoring
from lodestone.llm.line_dedup import op5_line_dedup
from lodestone.llm.media import op9_media_columns
from lodestone.llm.packing import op8_packing, pack_conversations
from lodestone.llm.periodic_runs import op12_periodic_runs
from lodestone.llm.quality import op6_quality_classifier
from lodestone.llm.quality_rules import op11_quality_rules, quality_rule_ablations
from lodestone.llm.simhash import op2_simhash_near_dedup
from lodestone.llm.token_alignment import op13_token_alignment
from lodestone.llm.token_counts import op7_token_counts
from lodestone.llm.toxicity import op4_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_simhash_near_dedup,
        op3_benchmark_decontamination,
        op4_toxicity,
        op5_line_dedup,
        op6_quality_classifier,
        op7_token_counts,
        op8_packing,
        pack_conversations,
        op9_media_columns,
        op10_lm_scoring,
        op11_quality_rules,
        quality_rule_ablations,
        op12_periodic_runs,
        op13_token_alignment,
    )
}
ORACLE_SQL: dict[str, str] = {"op3_benchmark_decontamination": decontaminate.ORACLE} | quality_rules.ORACLE
