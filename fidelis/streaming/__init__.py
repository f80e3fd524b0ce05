"""The gate over arriving pairs."""
