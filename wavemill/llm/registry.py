"""Queries of this subpackage, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import jaccard, language, licences, lines, media, mix, neighbours, pieces, quality, tokenfile

QUERIES = {
    "op1_neighbours": neighbours.op1_neighbours,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_licences": licences.op3_licences,
    "op4_language": language.op4_language,
    "op5_source_mix": mix.op5_source_mix,
    "op6_pieces": pieces.op6_pieces,
    "op7_png_media": media.op7_png_media,
    "op8_jaccard": jaccard.op8_jaccard,
    "op9_token_file": tokenfile.op9_token_file,
    "op10_quality": quality.op10_quality,
}
ORACLES = {"op1_neighbours": neighbours.ORACLE, "op2_line_dedup": lines.ORACLE, "op5_source_mix": mix.ORACLE, "op8_jaccard": jaccard.ORACLE}
