"""The subpackage's registered queries."""

from __future__ import annotations

from tidewright.llm.decontaminate import op5_decontaminate
from tidewright.llm.html_text import op8_html_text
from tidewright.llm.near_dup import op9_minhash
from tidewright.llm.oracle import ORACLE_SQL as ORACLE_SQL
from tidewright.llm.packing import op2_packing
from tidewright.llm.pii import op1_pii
from tidewright.llm.quality import op4_quality
from tidewright.llm.suffix_sort import op10_suffix_sort
from tidewright.llm.suffix_tree import op3_suffix_trees
from tidewright.llm.token_files import op7_token_files
from tidewright.llm.warc import op6_warc

QUERIES = {
    "op1_pii": op1_pii,
    "op2_packing": op2_packing,
    "op3_suffix_trees": op3_suffix_trees,
    "op4_quality": op4_quality,
    "op5_decontaminate": op5_decontaminate,
    "op6_warc": op6_warc,
    "op7_token_files": op7_token_files,
    "op8_html_text": op8_html_text,
    "op9_minhash": op9_minhash,
    "op10_suffix_sort": op10_suffix_sort,
}
