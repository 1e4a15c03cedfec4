"""Training-data operators: dedup, search, language, mixing, scans, counts, decontamination and token files.

Nothing outside this subpackage imports it. Each module holds one operator with a general interface;
``queries`` derives the registered queries from them.
"""
