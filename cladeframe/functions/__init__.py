"""Column functions: names, flags, tags, CIGAR and MD."""
