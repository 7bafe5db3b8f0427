"""Reading and writing tables, profiles and staged intermediate results."""
