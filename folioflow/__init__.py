"""A Spark engine that turns documents of many formats into token-budgeted, anchored text sections."""
