"""The domain's tables over the test tables, and the registered queries."""
