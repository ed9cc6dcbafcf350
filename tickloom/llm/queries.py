"""All registered queries of this subpackage."""

from tickloom.llm import (  # noqa: F401
    divergence, fixity, leaks, licenses, ngramjoin, packing, periods, quality, repeats, secrets, sharding, tokencount, transcripts)
from tickloom.llm.registry import ORACLES as LLM_ORACLES
from tickloom.llm.registry import QUERIES as LLM_QUERIES

__all__ = ["LLM_ORACLES", "LLM_QUERIES"]
