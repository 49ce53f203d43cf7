"""DataFrame operators, grouped by the stage of the work they belong to."""
