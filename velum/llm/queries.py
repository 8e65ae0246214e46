"""One query for each text operator, over its whole table, with production parameters."""

from __future__ import annotations

from velum.llm import alignment, automaton, cascade, lines, mixing, neighbours, packing, perplexity, phrases, search, sketch, suffixes, templates
from velum.llm.shared import query

QUERIES = {
    "op1_block_max_wand": query(search.query, "documents"),
    "op2_perplexity_rules": query(perplexity.query, "documents"),
    "op3_source_mixing": query(mixing.query, "documents"),
    "op4_line_dedup": query(lambda documents: lines.query(documents, lines.SHORTEST, lines.NEAR_SHORTEST), "documents"),
    "op5_site_templates": query(templates.query, "pages"),
    "op6_suffix_automata": query(automaton.query, "documents"),
    "op7_suffix_merge": query(suffixes.query, "documents"),
    "op8_bin_slack_packing": query(packing.query, "documents"),
    "op9_latent_neighbours": query(neighbours.query, "documents", "labels"),
    "op10_setsketch_near_dup": query(sketch.query, "documents"),
    "op11_segment_alignment": query(alignment.query, "documents"),
    "op12_count_tries": query(phrases.query, "documents"),
    "op13_bloom_cascade": query(cascade.query, "pages"),
}
SQL = {"op3_source_mixing": mixing.oracle(), "op12_count_tries": phrases.oracle(), "op13_bloom_cascade": cascade.oracle()}
