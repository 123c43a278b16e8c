"""Writers: anchor text, topic statistics, run files."""
