"""Readers and writers: JSON lines, schemas, migrations, configuration, the table store."""
