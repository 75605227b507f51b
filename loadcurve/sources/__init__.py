from loadcurve.sources import sinks, tables

__all__ = ["sinks", "tables"]
