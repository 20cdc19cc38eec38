"""celldays: lazy DataFrame operators for gridded, day-stamped risk data on Spark."""
