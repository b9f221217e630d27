"""All registered queries of the subpackage."""

from __future__ import annotations

from importlib import import_module

from epifold.llm import registry

MODULES = ("q_minhash", "q_suffix", "q_pieces", "q_toxicity", "q_language", "q_quality", "q_neighbours", "q_mixing", "q_chat", "q_shards", "q_whitening", "q_negatives", "q_boosting")


def load() -> tuple[dict[str, registry.Build], dict[str, str]]:
    """Queries and their SQL checks by name."""
    for module in MODULES:
        import_module(f"epifold.llm.{module}")
    return registry.QUERIES, registry.SQL
