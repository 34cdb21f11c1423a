"""Named queries of this subpackage, and SQL where SQL can say the same over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import entity_match, markup, mixing, mojibake, names, neardup, packing, splitter, survivor


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": entity_match.found,
        "p1_matches": entity_match.matched,
        "p2_found": survivor.found,
        "p2_records": survivor.records,
        "p3_found": names.found,
        "p3_entities": names.entities,
        "p4_found": markup.found,
        "p5_found": splitter.found,
        "p7_found": neardup.found,
        "p8_pack": packing.packed,
        "p8_usage": packing.usage,
        "p9_mix": mixing.mixed,
        "p9_shares": mixing.shares,
        "p10_found": mojibake.found,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": survivor.found_sql(),
        "p2_records": survivor.found_sql(values=True),
        "p5_found": """
            SELECT 'ingestion_results.content' AS field_name, result_id AS row_id FROM ingestion_results, split_limits
            WHERE field_name = 'ingestion_results.content' AND length(content) > max_chars
            UNION ALL
            SELECT 'sections.markdown', section_id FROM sections, split_limits WHERE field_name = 'sections.markdown' AND length(markdown) > max_chars""",
    }
