"""Registered queries: what each operator does on the standard tables, and the same in SQL."""
