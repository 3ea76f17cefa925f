"""Price-quote arbitrage analytics as Spark DataFrame jobs."""
