"""Registered queries, their SQL counterparts, and the adapters that feed them."""
