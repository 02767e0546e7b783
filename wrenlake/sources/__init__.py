"""Reading tables, declared schemas, validation and table writes."""
