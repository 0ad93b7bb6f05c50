"""A PySpark engine that turns dated, rated texts with vectors into evidence documents per entity."""
