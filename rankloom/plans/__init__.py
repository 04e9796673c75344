"""The registered queries: one for each operator, with the SQL it must equal."""
