"""Training-data operators: license scans, chat formatting, near-duplicates, LM scoring,
packing, byte-level BPE, language ID, quality rules, line dedup and embedding near-dedup.

Nothing outside this package imports it.
"""
