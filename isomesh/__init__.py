"""isomesh: accessibility analytics on Apache Spark.

Origins, destinations, a transport network and optionally a timetable go in as
DataFrames; reachability, travel measures and their aggregates come out as DataFrames.
"""
