"""Where PDF files come from and where results go."""
