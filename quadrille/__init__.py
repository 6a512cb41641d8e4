"""Spreadsheet-shaped analytics on Spark: formulas, rules, edits and formats as DataFrame expressions."""
