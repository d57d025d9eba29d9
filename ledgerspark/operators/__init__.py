"""Operators: audit, validated joins, the analysis table, metrics, quality control, inference."""
