"""Query plans: the registered end-to-end jobs and their SQL oracles."""
