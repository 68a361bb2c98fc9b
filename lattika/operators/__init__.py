"""DataFrame operators: statistics, joins, regions, transforms, ranking."""
