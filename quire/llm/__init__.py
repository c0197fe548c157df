"""Training-data operators: classifiers, joins, packing, mixing, scoring and shard output."""
