"""The queries of the operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .chats import OP4_SQL, op4_tool_calls
from .language import op8_language
from .mixing import op5_mixing
from .packing import op6_best_fit
from .quality import op3_quality
from .rules import op9_rules
from .simhash import op1_simhash
from .sketches import op2_iblt
from .substrings import op10_substrings
from .toxicity import op7_toxicity


def queries() -> dict:
    return {
        "op1_simhash": op1_simhash,
        "op2_iblt": op2_iblt,
        "op3_quality": op3_quality,
        "op4_tool_calls": op4_tool_calls,
        "op5_mixing": op5_mixing,
        "op6_best_fit": op6_best_fit,
        "op7_toxicity": op7_toxicity,
        "op8_language": op8_language,
        "op9_rules": op9_rules,
        "op10_substrings": op10_substrings,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_tool_calls": OP4_SQL}
