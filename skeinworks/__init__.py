"""skeinworks: graph, retrieval, session and corpus analytics written for Spark."""
