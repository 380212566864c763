"""End-to-end studies, and the registered queries over the benchmark tables."""
