"""DataFrame operators: each takes and returns ``DataFrame``."""
