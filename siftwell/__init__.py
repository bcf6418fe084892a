"""siftwell: turns large tables of scraped pages and postings into a clean, searchable corpus on Spark."""
