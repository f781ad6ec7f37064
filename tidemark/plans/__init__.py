"""Plans that combine operators into tables, and the registered queries."""
