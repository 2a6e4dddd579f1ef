"""Reading and writing tables, schemas and table checks."""
