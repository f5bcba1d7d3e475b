"""All queries outside millrace.llm, and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("operators.provenance", "operators.survival", "operators.measures", "operators.selection", "operators.rules", "operators.merges", "operators.cohorts", "operators.content", "operators.upkeep", "operators.parts", "operators.policy", "operators.verdicts", "operators.places", "operators.clusters", "operators.vectors", "operators.postings", "operators.hotkeys", "functions.names", "functions.pay", "functions.urls", "functions.platforms", "streaming.events", "streaming.keyed", "sources.feeds", "sources.discovery", "sources.mailbox", "sources.messages")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"millrace.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
