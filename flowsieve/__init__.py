"""flowsieve: network-flow analytics and attack scoring as Spark DataFrame operators."""
