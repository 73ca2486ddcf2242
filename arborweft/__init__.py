"""arborweft: graph, text and event analytics expressed as Spark DataFrame plans."""
