"""Disclosure analytics engine on Spark: typed sources, relational and text operators, entity resolution, graphs and event logs."""
