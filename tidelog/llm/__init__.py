"""Operators of a training-data pipeline: deduplication, mixing, packing, media, quality, licences, toxicity,
page text, tokenising and language-model scoring.

Nothing outside this subpackage imports it.  Each module holds one operator with its general interface; the thin
``opN_<name>`` queries are in :mod:`tidelog.llm.queries`.
"""
