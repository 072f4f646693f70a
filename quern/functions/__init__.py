"""Column functions: cleaning, text features, labels and verdicts. All of them stay inside the JVM unless they say otherwise."""
