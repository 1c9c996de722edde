"""DataFrame-to-DataFrame operators over the tables of quirefold.schema."""
