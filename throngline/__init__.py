"""throngline: crowd-flow analytics as Spark DataFrame jobs.

``operators``  geometry, density, movement, risk and alert operators
``sources``    table bridges, scene files, alert and audit stores
``functions``  reusable Column builders
``plans``      named queries and their SQL oracles
``streaming``  Structured Streaming forms of the risk and alert operators
"""
