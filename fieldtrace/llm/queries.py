"""The registered queries of the corpus operators."""

from __future__ import annotations

import importlib

from fieldtrace.llm import common

MODULES = ("substring_dedup", "language_id", "decontaminate", "url_filter", "pieces", "importance", "zip_warc", "host_rules", "ngram_join", "line_dedup", "turn_repair",
           "simhash_tree", "hard_negatives")


def all_queries():
    for module in MODULES:
        importlib.import_module(f"fieldtrace.llm.{module}")
    return common.QUERIES, common.ORACLES
