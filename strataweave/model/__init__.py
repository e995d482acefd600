"""Declarations kept on the driver: schemas, migrations, recipes, the registry."""
