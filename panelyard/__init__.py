"""panelyard: a point-in-time daily panel research engine on PySpark."""
