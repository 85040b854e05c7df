"""Training-data operators: cleaning, deduplication, decontamination and packing of text corpora.

Nothing else in the library imports this sub-package. Each module holds one
operator with a general interface; ``queries.py`` registers the thin queries.
"""
