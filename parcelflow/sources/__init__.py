"""Sheet metadata in, parcels and blocks out."""
