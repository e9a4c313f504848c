"""Sources: files of a repository, and tables projected onto the artifact model."""
