"""Tables: schemas applied on read, day-partitioned writes, stand-in fixtures."""
