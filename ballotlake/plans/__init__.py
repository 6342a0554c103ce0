"""The registered queries and, for each, the same question in plain SQL."""
