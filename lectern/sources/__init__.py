"""Connectors: files, repositories, SQLite databases of mail, feed and e-book programs."""
