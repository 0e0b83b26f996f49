"""The analyses, one module per family; every operator is DataFrame -> DataFrame."""
