"""Corpus-preparation operators: mixing, licences, decontamination, scoring, deduplication, PII."""
