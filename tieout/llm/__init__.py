"""Operators for preparing large text corpora; ``queries`` registers one query for each."""
