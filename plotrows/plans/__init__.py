"""End-to-end plans and the query catalog (``catalog.QUERIES`` / ``catalog.ORACLE``)."""
