"""The registered queries and their reference SQL."""
