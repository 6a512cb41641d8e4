"""Operators on sheets: formulas, rules, edits, shapes, ranges and dictionaries."""
