"""Sources: tables, text corpora, application code, mapper XML and migration projects."""
