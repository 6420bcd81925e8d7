"""lexgrove: evidence-grounded analysis of regulatory text and corpora on Spark."""
