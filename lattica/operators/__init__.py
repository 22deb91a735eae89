"""Operators on DataFrames of vertices, objects, manifests, groups and links.

A vertex row has an id ``vid``, an object id ``oid``, its place ``seq`` in the object, a
position ``x, y, z`` (or fewer axes) and any attributes; cells are ``cx, cy, cz``.
"""
