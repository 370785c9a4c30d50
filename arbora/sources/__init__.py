"""Model tables on disk and text trees."""
