"""Operators of a training-data pipeline: mixing, sharding, language models,
language identification, deduplication, chat formatting, exact search,
quality regression and decontamination.

Nothing else in the library imports this subpackage.
"""
