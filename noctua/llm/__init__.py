"""Training-data operators: one module per operator, their queries and oracles
in `queries`.  Nothing outside this package imports it except the guarded
hook in `__spark_entry__.py` and `corpus_pipeline.py`."""
