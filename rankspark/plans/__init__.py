"""Query catalogue: every operator on the mapped views, with the SQL it must agree with."""
