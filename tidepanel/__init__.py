"""tidepanel: analytics over long (symbol, ts) market panels, expressed as Spark jobs."""
__version__ = "0.1.0"
