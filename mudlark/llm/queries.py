"""The queries of this subpackage, by name."""

from __future__ import annotations

from mudlark.llm.bagminhash import op8_bagminhash
from mudlark.llm.chat_format import ORACLE as CHAT_SQL
from mudlark.llm.chat_format import op1_chat
from mudlark.llm.media import op10_media
from mudlark.llm.mixing import op2_mixing
from mudlark.llm.oracles import SUFFIX, quality_sql
from mudlark.llm.quality import op6_quality
from mudlark.llm.sentencepiece_lattice import op5_sentencepiece
from mudlark.llm.sharding import op4_sharding
from mudlark.llm.suffix_dedup import op3_suffix
from mudlark.llm.toxicity import op9_toxicity
from mudlark.llm.warc import ORACLE as WARC_SQL
from mudlark.llm.warc import op7_warc

QUERIES = {
    "op1_chat": op1_chat,
    "op2_mixing": op2_mixing,
    "op3_suffix": op3_suffix,
    "op4_sharding": op4_sharding,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_quality": op6_quality,
    "op7_warc": op7_warc,
    "op8_bagminhash": op8_bagminhash,
    "op9_toxicity": op9_toxicity,
    "op10_media": op10_media,
}

ORACLES: dict[str, str] = {
    "op1_chat": CHAT_SQL,
    "op3_suffix": SUFFIX,
    "op6_quality": quality_sql(),
    "op7_warc": WARC_SQL,
}
