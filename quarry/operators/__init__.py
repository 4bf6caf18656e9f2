"""DataFrame operators: classification, deduplication, funnels, latest rows, pages, state."""
