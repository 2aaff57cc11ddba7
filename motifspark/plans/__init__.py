"""Whole plans: mining loops, graph views over relational tables, registered queries."""
