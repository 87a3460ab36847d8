"""All queries of this subpackage, and the SQL that DuckDB runs beside them."""

from __future__ import annotations

from spanloom.llm import languages, leaks, overlap, packing, repeats, tokenize, versions
from spanloom.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]

QUERIES = {
    "p2_found": overlap.p2_found,
    "p2_report": overlap.p2_report,
    "p3_found": versions.p3_found,
    "p4_found": leaks.p4_found,
    "p4_spans": leaks.p4_spans,
    "p4_clean_sources": leaks.p4_clean_sources,
    "p5_found": repeats.p5_found,
    "p5_share": repeats.p5_share,
    "p6_ids": tokenize.p6_ids,
    "p7_containers": packing.p7_containers,
    "p7_fill": packing.p7_fill,
    "p8_found": languages.p8_found,
    "p8_segments": languages.p8_segments,
    "p8_documents": languages.p8_documents,
}
