"""Scripts: text filters, statements, and the run of all sinks of a script."""
