"""Query registry over the star schema."""
