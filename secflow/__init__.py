"""Security-event analytics on PySpark: normalise, detect, correlate, search, evaluate."""
