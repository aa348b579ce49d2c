"""Training-data operators: tokens, deduplication, quality, mixing, extraction, chat, search.

Each module holds one operator with a general interface; ``queries`` binds
them to the synthetic tables. Nothing outside this subpackage imports it.
"""
