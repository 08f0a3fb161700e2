"""Where corpora come from: tables, ingested sources and logs."""
