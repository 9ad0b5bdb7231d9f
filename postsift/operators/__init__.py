"""DataFrame -> DataFrame operators: de-dup/caps, filters, joins, unions, aggregates, segments, models."""
