"""The registered queries: each plan next to the SQL it is compared with."""
