"""Document-retrieval analytics as DataFrame operators: tables in, tables out."""
