"""Training-data operators: deduplication, filters, tokens and packing. Nothing else imports this package."""
