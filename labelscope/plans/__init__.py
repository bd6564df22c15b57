"""Role tables over the driver data and the registered queries."""
