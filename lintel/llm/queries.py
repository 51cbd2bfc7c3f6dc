"""The queries of the training-data operators, and DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lintel.llm.collocations import OP11_SQL, op11_collocations
from lintel.llm.decontaminate import OP12_SQL, op12_decontaminate
from lintel.llm.html_text import op10_html_text
from lintel.llm.jaccard import op3_jaccard
from lintel.llm.language_id import op1_language_id
from lintel.llm.neighbours import op2_neighbours
from lintel.llm.packing import op9_packing
from lintel.llm.sampled_pieces import op8_sampled_pieces
from lintel.llm.sharding import op4_sharding
from lintel.llm.spelling import OP13_SQL, op13_spelling
from lintel.llm.toxicity import op5_toxicity
from lintel.llm.warc import op6_warc
from lintel.llm.winnowing import OP7_SQL, op7_winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_neighbours": op2_neighbours,
    "op3_jaccard": op3_jaccard,
    "op4_sharding": op4_sharding,
    "op5_toxicity": op5_toxicity,
    "op6_warc": op6_warc,
    "op7_winnowing": op7_winnowing,
    "op8_sampled_pieces": op8_sampled_pieces,
    "op9_packing": op9_packing,
    "op10_html_text": op10_html_text,
    "op11_collocations": op11_collocations,
    "op12_decontaminate": op12_decontaminate,
    "op13_spelling": op13_spelling,
}

ORACLE_SQL: dict[str, str] = {
    "op7_winnowing": OP7_SQL,
    "op11_collocations": OP11_SQL,
    "op12_decontaminate": OP12_SQL,
    "op13_spelling": OP13_SQL,
}
