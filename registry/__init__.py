"""The registered queries and the SQL each of them must agree with."""
