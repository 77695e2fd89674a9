"""Training-data operators: deduplication, packing, mixing, filtering and extraction.

Each module holds one operator with a general interface; ``queries`` derives
from them the thin queries registered in ``__spark_entry__.py``.
"""
