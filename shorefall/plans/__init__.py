"""Plans: whole tables put together from operators, and the registered queries."""
