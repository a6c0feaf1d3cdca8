"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from .decontaminate import op6_decontaminate
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .license_scan import op5_license_scan
from .line_dedup import OP10_SQL, op10_line_dedup
from .mixing import op1_mixing
from .near_dedup import OP9_SQL, op9_near_dedup
from .ngram_join import OP13_SQL, op13_ngram_join
from .personal_data import op3_personal_data
from .prefix_trie import OP12_SQL, op12_prefix_trie
from .quality import op2_quality
from .source_audit import OP11_SQL, op11_source_audit
from .suffix_dedup import OP7_SQL, op7_suffix_dedup
from .token_files import op8_token_files

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality": op2_quality,
    "op3_personal_data": op3_personal_data,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_decontaminate": op6_decontaminate,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_token_files": op8_token_files,
    "op9_near_dedup": op9_near_dedup,
    "op10_line_dedup": op10_line_dedup,
    "op11_source_audit": op11_source_audit,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_ngram_join": op13_ngram_join,
}

ORACLE_SQL = {
    "op4_exact_dedup": OP4_SQL,
    "op7_suffix_dedup": OP7_SQL,
    "op9_near_dedup": OP9_SQL,
    "op10_line_dedup": OP10_SQL,
    "op11_source_audit": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_ngram_join": OP13_SQL,
}
