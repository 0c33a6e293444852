"""Column expression builders: functions of columns and fitted values."""
