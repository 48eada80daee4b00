"""Operators for preparing training text: every module is a DataFrame -> DataFrame function.

Nothing outside this package imports it. Each operator takes ``id_col`` and ``text_col`` names and
reads only those columns, so other columns, whatever their names, cannot clash with its own.
"""
