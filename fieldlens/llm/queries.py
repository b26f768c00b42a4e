"""All training-data queries; importing this module registers them."""

from fieldlens.llm import decontamination, exact_dedup, language_id, ngram_join, packing, phrase_dedup, suffix_dedup, token_counts, token_files, url_reputation  # noqa: F401
from fieldlens.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
