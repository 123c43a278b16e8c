"""DataFrame operators: term hits, statistics, links, scoring, ranking."""
