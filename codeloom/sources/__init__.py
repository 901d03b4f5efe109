"""Where source files and graphs are read from and written to."""
