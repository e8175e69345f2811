"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op11_alignment
from .bpe_codec import op7_bpe_codec
from .chat import OP5_SQL, op5_chat
from .decontaminate import OP4_SQL, op4_decontaminate
from .exact_dedup import OP2_SQL, op2_exact_dedup
from .html_text import op3_html_text
from .line_dedup import OP6_SQL, op6_line_dedup
from .phrases import OP13_SQL, op13_phrases
from .piece_codec import op12_piece_codec
from .quality import op8_quality
from .simhash import op10_simhash
from .substring_dedup import op9_substring_dedup
from .token_counts import op1_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_html_text": op3_html_text,
        "op4_decontaminate": op4_decontaminate,
        "op5_chat": op5_chat,
        "op6_line_dedup": op6_line_dedup,
        "op7_bpe_codec": op7_bpe_codec,
        "op8_quality": op8_quality,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_simhash": op10_simhash,
        "op11_alignment": op11_alignment,
        "op12_piece_codec": op12_piece_codec,
        "op13_phrases": op13_phrases,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": OP2_SQL,
        "op4_decontaminate": OP4_SQL,
        "op5_chat": OP5_SQL,
        "op6_line_dedup": OP6_SQL,
        "op13_phrases": OP13_SQL,
    }
