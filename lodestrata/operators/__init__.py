"""DataFrame operators: as-of lookups, interval joins, slowly changing dimensions, spines and comparisons."""
