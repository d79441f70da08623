"""All queries of this subpackage."""

from scalemetrics.llm import (  # noqa: F401
    chat_repair, minhash, mixing, packing, phrases, pieces, quality_cnn, quality_rules, rotation_codes, sharding, structure_repair, token_counts, toxicity,
)
from scalemetrics.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
