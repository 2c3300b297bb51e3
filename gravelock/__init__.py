"""A Spark-native engine for AND/OR exploit graphs: build, expand, prune, rank, compare, cluster, embed, lay out."""
