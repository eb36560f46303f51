"""Reading recordings and tables, and writing results."""
