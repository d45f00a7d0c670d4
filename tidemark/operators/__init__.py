"""DataFrame-to-DataFrame operators over many series at once."""
