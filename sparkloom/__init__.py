"""sparkloom: document retrieval, graph analytics and corpus preparation as Spark jobs."""
