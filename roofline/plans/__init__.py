"""Test-data adapters, the registered queries and their SQL oracles."""
