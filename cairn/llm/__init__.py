"""Corpus preparation operators: one module each, their queries in ``queries``."""
