"""DataFrame-to-DataFrame operators: PDF files to tables, elements to lines and blocks."""
