"""Typed-term logic programs on Spark: domains, models, rules, transforms and incremental sessions."""
