"""Where tables, documents and files are read and written."""
