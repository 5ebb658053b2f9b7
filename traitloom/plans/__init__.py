"""Registered queries over the supplied tables, one module per operator group."""

from . import extension_queries, geometry_queries, io_queries, landmark_queries, linkage_queries, lookup_queries, metrics_queries, model_queries, naming_queries, phenology, stats_queries

MODULES = (phenology, naming_queries, linkage_queries, stats_queries, geometry_queries, metrics_queries, model_queries, landmark_queries, lookup_queries, io_queries, extension_queries)
