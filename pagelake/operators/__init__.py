"""Table-to-table jobs over pages, edges, posts and the crawl ledger."""
