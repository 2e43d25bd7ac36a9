"""rookery: a Spark-native analytics engine over social-network event tables."""
