"""Reading and writing tables, documents and the schema memory."""
