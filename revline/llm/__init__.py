"""Operators for preparing training data: language, duplicates, quality, mixing and tokens.

Each module holds one operator as DataFrame functions; ``queries`` registers one query per operator.
Nothing outside this package imports it.
"""
