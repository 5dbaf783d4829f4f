"""Functions over terms and lists as column expressions."""
