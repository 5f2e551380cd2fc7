"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .chat import OP5_SQL, op5_chat
from .decontaminate import OP8_SQL, op8_decontaminate
from .extract import op2_html_extraction
from .linechunks import op7_line_chunks
from .minhash import op6_near_duplicates
from .mixing import OP9_SQL, op9_mixing
from .quality import op10_quality
from .toxicity import op3_toxicity
from .urlfilter import OP4_SQL, op4_url_filter
from .warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_html_extraction": op2_html_extraction,
    "op3_toxicity": op3_toxicity,
    "op4_url_filter": op4_url_filter,
    "op5_chat": op5_chat,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_line_chunks": op7_line_chunks,
    "op8_decontaminate": op8_decontaminate,
    "op9_mixing": op9_mixing,
    "op10_quality": op10_quality,
}

ORACLE_SQL = {"op1_warc": OP1_SQL, "op4_url_filter": OP4_SQL, "op5_chat": OP5_SQL, "op8_decontaminate": OP8_SQL, "op9_mixing": OP9_SQL}
