"""Sources and sinks: catalogs, the versioned store, inference of entities."""
