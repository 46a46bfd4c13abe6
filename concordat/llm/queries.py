"""The queries of this subpackage, by name, and the SQL of those that SQL expresses."""

from __future__ import annotations

from .byte_bpe import op13_byte_bpe
from .centroid_clustering import OP11_SQL, op11_centroid_clustering
from .conversation_trie import OP12_SQL, op12_conversation_trie
from .decontamination import op6_decontamination
from .html_extraction import op7_html_extraction
from .jaccard_join import OP8_SQL, op8_jaccard_join
from .language_id import op4_language_id
from .quality_classifier import op10_quality_classifier
from .quality_rules import op3_quality_rules
from .source_mixing import op9_source_mixing
from .suffix_dedup import op5_suffix_dedup
from .token_counts import op1_token_counts
from .url_filters import OP2_SQL, op2_url_filters

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_url_filters,
        op3_quality_rules,
        op4_language_id,
        op5_suffix_dedup,
        op6_decontamination,
        op7_html_extraction,
        op8_jaccard_join,
        op9_source_mixing,
        op10_quality_classifier,
        op11_centroid_clustering,
        op12_conversation_trie,
        op13_byte_bpe,
    )
}
ORACLE_SQL = {"op2_url_filters": OP2_SQL, "op8_jaccard_join": OP8_SQL, "op11_centroid_clustering": OP11_SQL, "op12_conversation_trie": OP12_SQL}
