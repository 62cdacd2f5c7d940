"""graphloom: labelled property multigraphs and program-graph detection as Spark plans."""
