"""graphlens: relational analysis of source repositories and text corpora on Spark."""
