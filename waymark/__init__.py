"""A gazetteer and fuzzy place-search engine on Spark."""
