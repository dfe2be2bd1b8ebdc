"""Web-page audit analytics on Spark: facts, rules, scores, link graphs and batch tables."""
