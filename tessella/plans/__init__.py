"""Plans: the export flow and the queries bound to the driver's tables."""
