"""Queries of the llm operators and their SQL."""

from __future__ import annotations

from corpuskit.llm.cap_filters import op6_cap_filters
from corpuskit.llm.collocations import OP12_SQL, op12_collocations
from corpuskit.llm.decontamination import OP11_SQL, op11_decontamination
from corpuskit.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from corpuskit.llm.language_id import language_of_pages, op1_language_id
from corpuskit.llm.lm_scores import op5_lm_scores
from corpuskit.llm.ngram_join import op3_ngram_jaccard
from corpuskit.llm.packing import op9_packing
from corpuskit.llm.pii import op2_pii
from corpuskit.llm.secrets import op7_secrets
from corpuskit.llm.sentence_pieces import op4_sentence_pieces
from corpuskit.llm.token_files import op10_token_files
from corpuskit.llm.whitening import op13_whitening

QUERIES = {
    "op1_language_id": op1_language_id,
    "language_of_pages": language_of_pages,
    "op2_pii": op2_pii,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_sentence_pieces": op4_sentence_pieces,
    "op5_lm_scores": op5_lm_scores,
    "op6_cap_filters": op6_cap_filters,
    "op7_secrets": op7_secrets,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_packing": op9_packing,
    "op10_token_files": op10_token_files,
    "op11_decontamination": op11_decontamination,
    "op12_collocations": op12_collocations,
    "op13_whitening": op13_whitening,
}


def pipeline(spark, sf_dir):
    """The stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
ORACLES = {"op8_exact_dedup": OP8_SQL, "op11_decontamination": OP11_SQL, "op12_collocations": OP12_SQL}
