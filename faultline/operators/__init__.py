"""Relational operators over fact tables: catching, graph, propagation, resolution, declarations."""
