"""Named jobs (P1-P6) composed from the operators, and the query catalog."""
