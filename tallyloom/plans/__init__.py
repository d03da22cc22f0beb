"""Queries over the order tables, with the SQL that checks them."""
