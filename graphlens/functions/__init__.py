"""Scalar functions as Column expressions; the few that need a bracket stack or a parser are Arrow-batched UDFs."""
