"""Operators for preparing large text corpora (training data).

Nothing outside this package (and ``corpus_pipeline.py``) imports it. Every
operator takes DataFrames, selects only the columns it needs by name (other
columns, whatever they are called, are ignored or carried through
untouched) and keeps its intermediate tables under ``spark.checkpoint.dir``.
"""
