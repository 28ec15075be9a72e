"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from graniteflow.llm.alignment import op11_align
from graniteflow.llm.chat import op12_chat
from graniteflow.llm.fingerprints import op1_fingerprint
from graniteflow.llm.html import op9_html
from graniteflow.llm.langid import op8_langid
from graniteflow.llm.media import op10_media
from graniteflow.llm.neardup import op7_neardup
from graniteflow.llm.oracles import ORACLES
from graniteflow.llm.packing import op3_pack
from graniteflow.llm.periodic import op13_periodic
from graniteflow.llm.pieces import op5_pieces
from graniteflow.llm.sharding import op4_shard
from graniteflow.llm.toxicity import op2_toxicity
from graniteflow.llm.warc import op6_warc

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    "op1_fingerprint": op1_fingerprint,
    "op2_toxicity": op2_toxicity,
    "op3_pack": op3_pack,
    "op4_shard": op4_shard,
    "op5_pieces": op5_pieces,
    "op6_warc": op6_warc,
    "op7_neardup": op7_neardup,
    "op8_langid": op8_langid,
    "op9_html": op9_html,
    "op10_media": op10_media,
    "op11_align": op11_align,
    "op12_chat": op12_chat,
    "op13_periodic": op13_periodic,
}
