"""Training-data operators: extraction, deduplication, decontamination, tokenisation and classification.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrames to DataFrames; :mod:`tesserine.llm.queries` derives the registered
queries from them.
"""
