"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, chat, htmltext, jpeg, katz, langid, neardup, packing, pii, quality

QUERIES = {
    "op1_katz": katz.op1_katz,
    "op10_neardup": neardup.op10_neardup,
    "op2_bpe": bpe.op2_bpe,
    "op3_htmltext": htmltext.op3_htmltext,
    "op4_quality": quality.op4_quality,
    "op5_langid": langid.op5_langid,
    "op6_packing": packing.op6_packing,
    "op7_jpeg": jpeg.op7_jpeg,
    "op8_chat": chat.op8_chat,
    "op9_pii": pii.op9_pii,
}

ORACLE: dict[str, str] = {
    "op1_katz": katz.OP1_SQL,
    "op8_chat": chat.OP8_SQL,
}
