"""Column functions: calendar, holidays and cyclical encodings."""
