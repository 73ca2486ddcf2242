"""Queries of the text problems and, where SQL can say the same on whole tables, that SQL."""

from __future__ import annotations

from arborweft.llm import conversations, docpairs, leakage, packing, provenance, quality
from arborweft.llm.syntax import check
from arborweft.sources.tables import load

QUERIES = {
    "p1_found": docpairs.found,
    "p1_pairs": docpairs.all_pairs,
    "p1_from_sources": docpairs.from_sources,
    "p4_found": conversations.found,
    "p4_turns": lambda s, d: conversations.turns(load(s, d, "transcript_entries")),
    "p4_clock_offsets": lambda s, d: conversations.clock_offsets(load(s, d, "transcript_entries")),
    "p4_corrections": conversations.correction_report,
    "p5_found": check.found,
    "p5_verdicts": lambda s, d: check.verdicts(load(s, d, "files"), load(s, d, "source_texts")),
    "p5_rates": check.rates,
    "p6_found": provenance.found,
    "p6_report": provenance.handwritten,
    "p8_containers": packing.packed,
    "p8_fill": packing.fill_report,
    "p9_found": leakage.found,
    "p9_items": leakage.leaked_items,
    "p10_found": quality.found,
    "p10_stats": lambda s, d: quality.stats(load(s, d, "documents")),
    "p10_lines": lambda s, d: quality.line_shares(load(s, d, "documents")),
}

ORACLE = {
    "p4_found": conversations.FOUND_SQL,
    "p4_turns": conversations.TURNS_SQL,
    "p4_clock_offsets": conversations.OFFSETS_SQL,
    "p10_stats": quality.stats_sql(),
}
