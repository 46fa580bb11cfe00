"""Jobs composed from the operators: build, search, status and refresh."""
