"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ownerloom.llm.compaction import OP10_SQL, op10_compaction
from ownerloom.llm.curriculum import OP12_SQL, op12_curriculum
from ownerloom.llm.decontaminate import op4_decontamination
from ownerloom.llm.langid import op8_language
from ownerloom.llm.lexical import OP13_SQL, op13_ranked_search
from ownerloom.llm.packing import op7_packing
from ownerloom.llm.quality import op2_quality
from ownerloom.llm.rules import OP6_SQL, op6_quality_rules
from ownerloom.llm.simhash import op3_simhash
from ownerloom.llm.sstable import op9_sorted_tables
from ownerloom.llm.urls import op1_url_filter
from ownerloom.llm.warc import OP5_SQL, op5_warc_records
from ownerloom.llm.whitening import op11_whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_quality": op2_quality,
        "op3_simhash": op3_simhash,
        "op4_decontamination": op4_decontamination,
        "op5_warc_records": op5_warc_records,
        "op6_quality_rules": op6_quality_rules,
        "op7_packing": op7_packing,
        "op8_language": op8_language,
        "op9_sorted_tables": op9_sorted_tables,
        "op10_compaction": op10_compaction,
        "op11_whitening": op11_whitening,
        "op12_curriculum": op12_curriculum,
        "op13_ranked_search": op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_warc_records": OP5_SQL, "op6_quality_rules": OP6_SQL, "op10_compaction": OP10_SQL, "op12_curriculum": OP12_SQL, "op13_ranked_search": OP13_SQL}
