"""Strandloom: a PySpark-native engine for transcript-annotation quality control."""
