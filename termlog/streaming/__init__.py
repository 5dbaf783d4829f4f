"""Incremental evaluation: transactions, changes, and streams of them."""
