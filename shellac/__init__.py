"""Analytics and curation of media catalogs as DataFrame operators."""
