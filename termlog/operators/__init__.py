"""Operators over environments and relations."""
