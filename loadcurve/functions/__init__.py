from loadcurve.functions import scalars, times

__all__ = ["scalars", "times"]
