"""Column functions: text, codes and metrics. All stay in the JVM."""
