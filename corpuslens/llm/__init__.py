"""Operators for preparing training corpora of language models.

Nothing else in the library imports this subpackage; its queries are in
:mod:`corpuslens.llm.queries`.
"""
