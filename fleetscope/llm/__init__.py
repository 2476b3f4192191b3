"""Training-data operators: token counts, search, mixing, filters, dedup.

Nothing outside this folder and ``corpus_pipeline.py`` imports it; the whole
folder can be removed and the rest of the library still works.
"""
