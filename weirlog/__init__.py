"""DataFrame toolkit for partitioned message logs and the document store they feed."""
