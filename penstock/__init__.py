"""Product-event processing on Spark: validate, deduplicate, route, deliver, analyse."""
