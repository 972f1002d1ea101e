"""The registered queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from factloom.llm import ann, chat, decontaminate, langid, licenses, packing, secrets, simhash, toxicity, urlfilter

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_licenses": licenses.op2_licenses,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_ann": ann.op4_ann,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_packing": packing.op6_packing,
    "op7_urls": urlfilter.op7_urls,
    "op8_langid": langid.op8_langid,
    "op9_simhash": simhash.op9_simhash,
    "op10_chat": chat.op10_chat,
}

ORACLES = {
    "op1_secrets": secrets.OP1_SQL,
    "op2_licenses": licenses.OP2_SQL,
    "op7_urls": urlfilter.OP7_SQL,
    "op10_chat": chat.OP10_SQL,
}
