"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from logweave.llm.centroids import OP12_SQL, op12_centroids
from logweave.llm.chat import OP3_SQL, op3_chat
from logweave.llm.langid import op4_langid
from logweave.llm.lines import op1_lines
from logweave.llm.media import op9_media
from logweave.llm.minhash import op6_minhash
from logweave.llm.mixing import OP7_SQL, op7_mixing
from logweave.llm.neighbours import op10_neighbours
from logweave.llm.pieces import op5_pieces
from logweave.llm.quality import OP11_SQL, op11_quality
from logweave.llm.toxicity import op8_toxicity
from logweave.llm.warc import OP2_SQL, op2_warc
from logweave.llm.whitening import op13_whitening

QUERIES = {
    "op1_lines": op1_lines,
    "op2_warc": op2_warc,
    "op3_chat": op3_chat,
    "op4_langid": op4_langid,
    "op5_pieces": op5_pieces,
    "op6_minhash": op6_minhash,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_media": op9_media,
    "op10_neighbours": op10_neighbours,
    "op11_quality": op11_quality,
    "op12_centroids": op12_centroids,
    "op13_whitening": op13_whitening,
}

ORACLES = {
    "op2_warc": OP2_SQL,
    "op3_chat": OP3_SQL,
    "op7_mixing": OP7_SQL,
    "op11_quality": OP11_SQL,
    "op12_centroids": OP12_SQL,
}
