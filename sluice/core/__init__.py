"""Session, lineage and graph helpers shared by the operators."""
