"""The registered queries of this package, and SQL for those that it can express."""

from __future__ import annotations

from skerry.llm import op3_hyperminhash as op3
from skerry.llm import op5_topk as op5
from skerry.llm import op9_mixing as op9
from skerry.llm import op10_quality as op10
from skerry.llm.op1_urls import RULES_SQL, op1_urls, url_rules
from skerry.llm.op2_toxicity import op2_toxicity
from skerry.llm.op4_lm import BASE_SQL, lm_base, op4_lm
from skerry.llm.op6_secrets import op6_secrets
from skerry.llm.op7_chat import op7_chat
from skerry.llm.op8_packing import op8_packing

QUERIES = {
    "op1_urls": op1_urls,
    "op2_toxicity": op2_toxicity,
    "op3_hyperminhash": op3.op3_hyperminhash,
    "op4_lm": op4_lm,
    "op5_topk": op5.op5_topk,
    "op6_secrets": op6_secrets,
    "op7_chat": op7_chat,
    "op8_packing": op8_packing,
    "op9_mixing": op9.op9_mixing,
    "op10_quality": op10.op10_quality,
    # What SQL can express of op1 and op4.
    "url_rules": url_rules,
    "lm_base": lm_base,
}
ORACLE = {"op3_hyperminhash": op3.ORACLE, "op5_topk": op5.ORACLE, "op9_mixing": op9.oracle(), "op10_quality": op10.oracle(), "url_rules": RULES_SQL, "lm_base": BASE_SQL}
