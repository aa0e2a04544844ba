"""Operators: running plans over corpora, and corpus-wide joins, walks and reports."""
