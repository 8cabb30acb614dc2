"""Query plans: the registered driver queries and the three end-to-end
review flows, built from the operators."""
