"""Files as rows of documents, and reports as files."""
