"""Views of tables, log segments and sinks."""
