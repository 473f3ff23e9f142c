"""Column expressions: text, validators, masks. All of them stay in the JVM."""
