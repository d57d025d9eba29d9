"""Query plans: the overlay of the driver's tables and the catalogue of named queries."""
