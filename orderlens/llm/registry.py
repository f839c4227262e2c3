"""Queries and oracle SQL of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embeddings, langid, licenses, mixing, pieces, search, shingles, tokenfiles, tokens, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.op1_mixing,
    "op2_langid": langid.op2_langid,
    "op3_search": search.op3_search,
    "op4_jaccard": shingles.op4_jaccard,
    "op5_licenses": licenses.op5_licenses,
    "op6_token_files": tokenfiles.op6_token_files,
    "op7_pieces": pieces.op7_pieces,
    "op8_token_counts": tokens.op8_token_counts,
    "op9_warc": warc.op9_warc,
    "op10_embeddings": embeddings.op10_embeddings,
}

ORACLES: dict[str, str] = {**mixing.ORACLE, **warc.ORACLE}
