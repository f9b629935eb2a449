"""Corpus operators for training-data pipelines.

Each module holds one operator with a general interface; ``queries`` applies
them to whole tables. Nothing outside this subpackage imports it.
"""
