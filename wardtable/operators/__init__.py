"""Table and model operators, all ``DataFrame -> DataFrame`` (or fit -> apply)."""
