"""One registered query per operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm.chat import op6_chat
from tidewatch.llm.collocations import op12_collocations
from tidewatch.llm.embeddings import op7_embeddings
from tidewatch.llm.language_model import op8_language_model
from tidewatch.llm.line_dedup import op4_line_dedup
from tidewatch.llm.mixing import op1_mixing
from tidewatch.llm.order_minhash import op5_order_minhash
from tidewatch.llm.packing import op10_packing
from tidewatch.llm.quality import op2_quality
from tidewatch.llm.ranking import op11_ranking
from tidewatch.llm.simhash import op3_simhash
from tidewatch.llm.url_rules import op13_url_filter
from tidewatch.llm.warc import op9_warc_audit


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_mixing, op2_quality, op3_simhash, op4_line_dedup, op5_order_minhash, op6_chat,
        op7_embeddings, op8_language_model, op9_warc_audit, op10_packing,
        op11_ranking, op12_collocations, op13_url_filter,
    )
    return {query.__name__: query for query in found}
