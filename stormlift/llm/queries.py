"""The corpus queries; the operator modules register themselves."""

from stormlift.llm import bpe, decontaminate, language, lines, pii, quality, secrets, simhash, topk, toxicity, trie, urls, whitening  # noqa: F401
from stormlift.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
