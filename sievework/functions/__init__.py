"""Column expressions: text, parsing, codes and scores. All of them stay inside the JVM."""
