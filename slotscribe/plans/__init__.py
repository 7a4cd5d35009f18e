"""Jobs made of the operators: the table store, batch commits, index runs and the reader."""
