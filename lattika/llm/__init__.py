"""Training-data operators: quality, near duplicates, language, secrets, licences, scoring, mixing, encoding, sharding, decontamination.

Nothing outside this subpackage imports it.
"""
