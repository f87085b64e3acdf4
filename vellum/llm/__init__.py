"""Operators for preparing large text corpora; nothing else in vellum imports this subpackage."""
