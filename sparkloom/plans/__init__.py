"""Query plans: the search plan, and the registered queries by subject."""
