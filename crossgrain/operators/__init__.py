"""DataFrame-to-DataFrame operators over panels keyed by (date, stock_code)."""
