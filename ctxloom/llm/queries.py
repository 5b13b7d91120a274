"""The registered queries of this subpackage."""

from __future__ import annotations

import importlib

#: Modules that register queries, one for every problem.
MODULES = ("q_budget", "q_documents", "q_code")


def register(reg) -> None:
    for m in MODULES:
        importlib.import_module(f"ctxloom.llm.{m}").register(reg)
