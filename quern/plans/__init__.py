"""Plans over the driver's tables: corpora of modules and the registered queries."""
