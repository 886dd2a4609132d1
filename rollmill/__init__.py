"""Rollout, reward and token-level analytics as Spark DataFrame operators."""
