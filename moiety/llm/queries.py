"""The queries of this subpackage and the SQL of those that SQL can express."""

import corpus_pipeline
from moiety.llm import ann, embedding_dedup, html_extract, line_dedup, ngram_join, packing, quality, sentencepiece_io, suffix_dedup, token_output

QUERIES = {
    "op2_html_extraction": html_extract.op2,
    "op9_sentencepiece": sentencepiece_io.op9,
    "op3_nearest_neighbours": ann.op3,
    "op4_line_dedup": line_dedup.op4,
    "op1_embedding_near_dedup": embedding_dedup.op1,
    "op8_quality_classifier": quality.op8,
    "op5_best_fit_packing": packing.op5,
    "op7_token_binary_output": token_output.op7,
    "op6_suffix_array_dedup": suffix_dedup.op6,
    "op10_ngram_jaccard_join": ngram_join.op10,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op4_line_dedup": line_dedup.OP4_SQL,
}
