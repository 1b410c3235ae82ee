"""Operators that prepare text corpora for model training.

Each module holds one operator with a general interface; ``queries`` derives the
registered queries from them. Nothing outside this subpackage imports it.
"""
