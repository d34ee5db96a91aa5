"""corpusloom: document analytics and retrieval expressed as Spark jobs."""
