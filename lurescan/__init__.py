"""PySpark jobs for URL and web-page risk data: clean, featurise, sample, score, evaluate, serve."""
