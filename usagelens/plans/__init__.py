"""End-to-end jobs composed of the operators: baseline, compare, activity and merges."""
