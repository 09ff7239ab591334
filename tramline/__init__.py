"""Public-transport timetables and journey planning as PySpark DataFrame code."""
