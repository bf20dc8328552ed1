"""Driver-side planning: arguments, filter banks, padding, paths. No data is touched here."""
