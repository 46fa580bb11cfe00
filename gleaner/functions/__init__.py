"""Column-level building blocks: text, paths, URLs, HTML, queries and hits."""
