"""Positional name search over large document collections, expressed as Spark plans."""
