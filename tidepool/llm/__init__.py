"""Training-data pipeline operators (HTML, quality, packing, encoding, PII, near-dedup, ...).

Nothing outside this subpackage imports it; ``__spark_entry__`` registers its
queries only when it is present.
"""
