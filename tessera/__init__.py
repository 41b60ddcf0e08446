"""tessera: document search, case preparation and pair explanation on Spark DataFrames.

Subpackages:
  functions  Column-expression builders (tokeniser, fact cascade, citations, vectors).
  sources    Schemas, scans and sinks, deterministic fixture views over the driver tables.
  operators  DataFrame -> DataFrame operators (prep, analysis, search, facets, vectors, explain).
  plans      Composite jobs: full search response, offline load.
  streaming  Incremental file loading with Structured Streaming.
"""

__version__ = "0.1.0"
