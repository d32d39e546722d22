"""quarrel: structural analytics over code-like facts, graphs, intervals and text, on Spark."""
