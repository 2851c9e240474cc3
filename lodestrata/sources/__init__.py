"""Reading catalogues, tables and files; writing results."""
