"""vinolake: catalogue data processing as PySpark DataFrame transformations."""
