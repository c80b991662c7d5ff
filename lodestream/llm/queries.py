"""The ten queries opN_<name>, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestream.llm.bagminhash import OP5_SQL, op5_bagminhash
from lodestream.llm.bitpack import op2_bitpack
from lodestream.llm.bpe import op9_bpe
from lodestream.llm.media import op4_media
from lodestream.llm.packing import op10_packing
from lodestream.llm.quality import OP1_SQL, op1_quality
from lodestream.llm.suffix_array import OP6_SQL, op6_suffix_array
from lodestream.llm.suffix_tree import OP3_SQL, op3_suffix_tree
from lodestream.llm.toxicity import op7_toxicity
from lodestream.llm.warc import OP8_SQL, op8_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_bitpack": op2_bitpack,
    "op3_suffix_tree": op3_suffix_tree,
    "op4_media": op4_media,
    "op5_bagminhash": op5_bagminhash,
    "op6_suffix_array": op6_suffix_array,
    "op7_toxicity": op7_toxicity,
    "op8_warc": op8_warc,
    "op9_bpe": op9_bpe,
    "op10_packing": op10_packing,
}

ORACLE: dict[str, str] = {"op1_quality": OP1_SQL, "op3_suffix_tree": OP3_SQL, "op5_bagminhash": OP5_SQL, "op6_suffix_array": OP6_SQL, "op8_warc": OP8_SQL}
