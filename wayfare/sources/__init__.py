"""Reading and writing files, tables, messages and polygons."""
