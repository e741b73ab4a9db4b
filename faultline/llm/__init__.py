"""Training-data operators: scoring, near and exact duplicates, language, archives, toxicity, chat, search, mixing, BPE.

Nothing else in the library imports this subpackage.
"""
