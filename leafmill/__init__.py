"""Document conversion and corpus building as DataFrame operators."""
