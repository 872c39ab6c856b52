"""DataFrame -> DataFrame operators on documents, lines, blocks and chunks."""
